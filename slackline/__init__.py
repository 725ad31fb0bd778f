"""slackline: critical-path analytics on weighted DAGs, and corpus preparation, as PySpark plans."""
