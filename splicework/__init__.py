"""Gene-structure analytics and training-data operators on PySpark."""
