"""Event-study analytics and corpus preparation, written for Spark's DataFrame engine."""
