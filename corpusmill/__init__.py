"""Spark-native corpus intelligence: chunking, versioning, search, selection, evaluation, trees, traces, audit."""
