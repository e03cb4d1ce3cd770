"""Spark-native scientometric analytics: attribution, indicators, identity, search and gates as DataFrame operators."""
