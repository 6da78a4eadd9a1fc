"""decidra: a Spark-native engine for building, auditing and measuring decision tables."""
