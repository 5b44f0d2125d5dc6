"""tarnflow: batch, iterative and incremental dataflow operators on PySpark."""
