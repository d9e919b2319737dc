"""emberlens: analytics over the logs of many Spark applications, as Spark jobs."""
