"""Content cataloguing and corpus preparation on PySpark."""
