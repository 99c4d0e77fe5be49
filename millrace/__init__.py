"""millrace: governed SQL and question-to-SQL corpus processing on Spark DataFrames."""
