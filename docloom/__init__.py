"""docloom: document analytics, retrieval and training-data operators on Spark DataFrames."""
