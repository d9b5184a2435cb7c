"""Event-time feature and evaluation operators as Spark DataFrame plans."""
