"""A keyspace analytics engine on Spark DataFrames."""
