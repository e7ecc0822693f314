"""Versioned key-value relations on Spark: every put and delete is a row of an operation log."""
