"""watchloom: a watchlist-screening and record-processing engine on PySpark DataFrames."""

__version__ = "0.1.0"
