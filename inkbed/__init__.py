"""inkbed: document-centred analytics on the Spark DataFrame and SQL APIs."""
