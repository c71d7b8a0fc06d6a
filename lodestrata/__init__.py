"""lodestrata: evidence-graph analytics and data-quality operators on Spark DataFrames."""

__version__ = "0.1.0"
