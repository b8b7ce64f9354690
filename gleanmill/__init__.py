"""gleanmill: the data work around automated research, as Spark jobs."""
