"""quirework: a PySpark-native analytics engine for collections of research papers."""

__version__ = "0.1.0"
