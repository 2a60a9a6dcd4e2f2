"""Manufacturing-quality analytics as lazy PySpark DataFrame operators."""
