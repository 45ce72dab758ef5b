"""quiltnet: DataFrame-first analytics over families of overlapping networks on Spark."""
