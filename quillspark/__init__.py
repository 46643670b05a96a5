"""Document-corpus analytics on Spark: search, audit and ingest as DataFrame operators."""
