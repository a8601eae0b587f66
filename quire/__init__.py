"""quire: document-structure analytics as Spark DataFrame plans."""
