"""querymill: an analytical query dialect and data-processing operators on PySpark."""
