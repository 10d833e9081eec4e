"""A PySpark-native engine for books, web documents and their text."""
