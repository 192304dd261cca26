"""Point-cloud analytics on Spark DataFrames: LAS files, geometry, codecs, data quality."""
