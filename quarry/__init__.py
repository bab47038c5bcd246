"""quarry: knowledge-graph query and evaluation operators as Spark DataFrame jobs."""
