"""Knowledge index over text corpora, built from Spark DataFrame operators."""

__version__ = "0.1.0"
