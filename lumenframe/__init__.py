"""lumenframe: profile, clean, model and evaluate tables of any size with PySpark."""

__version__ = "0.1.0"
