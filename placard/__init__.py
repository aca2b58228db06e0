"""placard: public-notice analytics on Spark DataFrames."""
