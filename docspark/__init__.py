"""docspark: document analytics as set-oriented Spark operators."""
