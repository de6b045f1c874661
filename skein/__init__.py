"""Spark-native graph matching engine: graphs are edge tables, operators return DataFrames."""
