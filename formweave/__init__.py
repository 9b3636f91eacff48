"""formweave: form-field linkage and text processing on Spark DataFrames."""
