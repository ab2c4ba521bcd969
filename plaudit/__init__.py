"""Review analytics on Spark DataFrames: aspect sentiment and reviewer credibility."""
