from .indexed import IndexRoot, SetIndexRoot
from .query import Grouped, Query

__all__ = ["Grouped", "IndexRoot", "Query", "SetIndexRoot"]
