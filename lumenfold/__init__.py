"""Lumenfold: a Spark-native engine for auditing and evaluating labelled, grouped and segmented datasets."""
