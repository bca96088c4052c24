"""A PySpark engine for searching, retaining and evaluating text corpora."""
