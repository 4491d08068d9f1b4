"""quire: document-library analytics as composable ``DataFrame -> DataFrame`` functions on Spark."""
