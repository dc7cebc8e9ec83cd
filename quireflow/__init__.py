"""A PySpark engine for document structuring and training-data preparation."""
