"""Spark-native analytics over recorded motion: observations in, diagnostic report out."""
