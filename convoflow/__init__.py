"""Spark-native engine for turning long text into conversational training data."""
