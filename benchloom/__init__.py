"""Spark-native engine for building, auditing and scoring question-answering benchmarks."""
