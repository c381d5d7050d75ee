"""strandwise: k-mer sequence search and run-metadata analytics on Spark DataFrames."""
