"""annalith: temporal text analytics as PySpark plans."""
