"""Spark-native clustering of sequencing reads, and of any items that share features."""
