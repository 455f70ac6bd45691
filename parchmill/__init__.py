"""Spark-native curation and evaluation of labelled text: parse, score, clean, pair, split, sample, judge."""
