"""sluice: change-data-capture analytics as Spark DataFrame and Structured Streaming jobs.

sources    change-feed decoding, envelope encoding, bootstrap scans
functions  column expressions shared by the operators
operators  dedup, mapping, schema evolution, XML, joins, aggregates, alerts, reports
plans      whole pipelines composed of operators
streaming  the same work over streams, and stateful operators
llm        training-data operators; nothing else imports it
"""
