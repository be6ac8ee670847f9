"""Transfer-network risk analytics as PySpark DataFrame operators."""
