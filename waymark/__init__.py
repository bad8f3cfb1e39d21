"""waymark: linear-referenced segment analytics as Spark DataFrame operators."""
