"""Typed, versioned datasets over Spark DataFrames."""

from .dataset import Catalog, Config, Dataset, Mode
from .operators import Grouped, IndexRoot, Query, SetIndexRoot

__all__ = ["Catalog", "Config", "Dataset", "Grouped", "IndexRoot", "Mode", "Query", "SetIndexRoot"]
