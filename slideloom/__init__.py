"""Table operators for spatial omics and whole-slide data on Spark."""

__version__ = "0.1.0"
