"""Wave-energy analytics on Spark: long (time, latitude, longitude) tables in, DataFrames out."""
