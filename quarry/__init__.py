"""A PySpark-native engine for filing analytics and training-data pipelines."""
