"""laborlens: job-market analytics as PySpark DataFrame operators."""
