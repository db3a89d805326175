"""docsift: document search, retrieval and training-data preparation on PySpark."""
