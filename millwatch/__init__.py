"""Fleet maintenance analytics as lazy Spark DataFrame operators."""
