"""rasterloom: image, annotation and training-data analytics declared as Spark plans."""

__version__ = "0.1.0"
