"""packspark: batched context retrieval and token-budget packing on Spark DataFrames."""
