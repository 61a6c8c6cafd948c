"""A knowledge-corpus and search-analytics engine on PySpark."""
