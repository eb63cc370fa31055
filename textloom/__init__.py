"""textloom: set-oriented analysis of structured text on Spark DataFrames."""
