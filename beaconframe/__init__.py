"""Radio-dispatch analytics on Spark: declarative batch and streaming operators."""
