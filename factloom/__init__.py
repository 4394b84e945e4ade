"""factloom: fact analytics on PySpark (joins, merges, fixpoints and value-flow search over tables)."""

from factloom.session import get_session

__all__ = ["get_session"]
