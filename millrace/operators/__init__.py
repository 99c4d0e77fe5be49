"""Corpus, comparison, sketch and candidate operators over DataFrames."""
