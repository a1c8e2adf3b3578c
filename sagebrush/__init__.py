"""Evidence analytics on PySpark: contract-checked tables, association
statistics and pre-declared decision rules as DataFrame plans."""
