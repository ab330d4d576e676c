"""sparkforest: rooted spanning forests and the data work around them, as Spark plans."""

__version__ = "0.1.0"
