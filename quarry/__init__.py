"""Evidence analytics on Spark: governed star-schema SQL, documents, retrieval, evidence and event streams."""
