"""Brindle: document retrieval and exact table analytics on Spark DataFrames."""
