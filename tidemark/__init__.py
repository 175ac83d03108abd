"""tidemark: audience-analytics operators written for Spark's DataFrame API."""
