"""Morton-key vector analytics expressed as Spark DataFrame plans."""
