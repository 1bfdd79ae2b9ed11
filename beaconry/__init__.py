"""Signal intelligence over landed public records, as Spark jobs."""
