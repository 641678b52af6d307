from graphloom.sources.tables import table

__all__ = ["table"]
