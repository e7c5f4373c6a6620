"""Document-graph construction and retrieval as Spark DataFrame operators."""
