"""Reading and writing: change feeds, target tables, payloads."""
