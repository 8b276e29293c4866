"""PySpark-native analytics over evidence-grounded trial assessments."""
