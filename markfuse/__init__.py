"""markfuse: a PySpark-native engine for analysing and fusing parsed documents."""
