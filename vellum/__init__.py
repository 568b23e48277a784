"""Document ingest and hybrid retrieval as Spark DataFrame plans."""

__version__ = "0.1.0"
