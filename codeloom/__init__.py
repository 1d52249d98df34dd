"""codeloom: code-graph analytics and text-corpus operators on PySpark DataFrames."""

__version__ = "0.1.0"
