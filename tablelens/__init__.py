"""Analytics over Spark DataFrames: profiles, statistics, series, text, pages, charts."""

__version__ = "0.1.0"
