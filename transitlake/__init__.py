"""Bus-location analytics as Spark DataFrame operators."""
