"""PySpark-native data preparation: plans compile to lazy DataFrames."""
