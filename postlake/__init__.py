"""Analytics for opportunity postings on PySpark."""
