"""motorloom: a Spark-native engine for semi-structured classified listings."""
