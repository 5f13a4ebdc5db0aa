"""Tessera: a Spark-native engine for curating, checking and scoring conversational training data."""
