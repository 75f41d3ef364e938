"""A PySpark-native engine that turns semi-structured extracted records into trusted tables and scores."""
