"""webkiln: web pages and text corpora processed as Spark DataFrames."""
