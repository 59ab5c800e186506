"""Reading libraries of files and provider answers as DataFrames."""
