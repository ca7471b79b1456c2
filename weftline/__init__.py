"""weftline: a Spark-first text-corpus analytics library."""
