"""Siltstone: analytics over software-engineering artifacts and text corpora, as PySpark DataFrame operators."""
