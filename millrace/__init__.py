"""millrace: a PySpark-native engine for evaluation results, documents and event logs."""
