"""tidemark: IoT event-stream aggregation and reconciliation on PySpark."""
