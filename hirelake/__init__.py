"""Job-market analytics on Spark: normalise, merge, search, score and track postings."""
