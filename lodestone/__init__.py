"""Lodestone: document, event and ruling analytics written as Spark DataFrame plans."""
