"""docflow: document preparation for retrieval and training corpora on PySpark."""
