"""Spark-native analytics over code-knowledge tables: relational, graph, text and vector operators as DataFrame plans."""
