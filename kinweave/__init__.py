"""Record linkage and master data on Spark: everything is a DataFrame in, a DataFrame out."""
