"""Text matching, selection, event and corpus operators on Spark DataFrames."""
