"""Media-catalogue analytics and training-data preparation on Spark DataFrames."""
