"""florilege: a PySpark-native retrieval and question-answering engine over collections of documents."""
