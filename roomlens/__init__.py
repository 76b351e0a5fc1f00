"""roomlens: a PySpark-native engine for room telemetry tables and corpus preparation."""
