"""Millrace: a PySpark-native engine for document ingestion, segmentation and retrieval."""
