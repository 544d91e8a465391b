"""Result auditing on PySpark: typed comparison of query results, and probes of single statements."""
