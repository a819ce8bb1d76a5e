"""Agreement analytics over free-text critiques and ratings, on Spark DataFrames."""
