"""Spark-native scoring of head-to-head spoken-word transcripts."""
