"""Set-at-a-time retrieval, evaluation and observability analytics on Spark."""
