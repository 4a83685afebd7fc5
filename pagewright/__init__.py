"""pagewright: document cleaning and token reduction on Spark DataFrames."""

__version__ = "0.1.0"
