"""quernlex: retrieval and evaluation over structured legal text, on Spark DataFrames."""

__version__ = "0.1.0"
