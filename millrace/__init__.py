"""millrace: relational, window, streaming and corpus operators written with PySpark."""
