"""Spark-native document ingestion: raw content-API JSON in, searchable points out."""
