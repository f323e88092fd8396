"""emberlens: filter, bucket and aggregate schemaless event logs with Spark plans."""
