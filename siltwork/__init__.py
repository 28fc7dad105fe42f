"""siltwork: a PySpark-native engine that ingests, distils and analyses text archives."""
