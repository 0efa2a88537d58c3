"""Gristmill: question-answering evaluation and corpus curation on Spark DataFrames."""
