"""slantree: oblique gradient boosting and its dataflow as Spark jobs."""
