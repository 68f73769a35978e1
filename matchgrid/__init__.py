"""matchgrid: embedding verification, retrieval and corpus analytics on Spark DataFrames."""
