"""quern: a Spark-native engine for operational data (series, logs, text, versioned records)."""
