"""Contract-driven time-series analytics, declared as Spark DataFrame plans."""
