"""tagloom: search, comparison, synchronisation and statistics of tagged records on Spark."""

__version__ = "0.1.0"
