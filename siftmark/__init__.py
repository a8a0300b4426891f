"""A PySpark-native engine for comparing binary payloads at scale."""
