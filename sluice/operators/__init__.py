"""Operators over decoded events and target tables; each takes and returns DataFrames."""
