"""Reading and writing corpora, results and split tables."""
