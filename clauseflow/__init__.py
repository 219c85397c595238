"""clauseflow: a PySpark engine for agreements, privacy policies and other long-form legal text."""
