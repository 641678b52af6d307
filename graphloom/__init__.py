"""graphloom: a PySpark-native engine for versioned code-structure graphs."""

__version__ = "0.1.0"
