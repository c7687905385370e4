"""A Spark-first engine for searching and analysing code and text corpora."""
