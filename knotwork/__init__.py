"""Knowledge-graph retrieval, health analytics and data processing on PySpark."""
