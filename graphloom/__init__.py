"""A graph-pattern analytics engine on Spark DataFrames."""

from .engine import Engine
from .sources.mapping import MappedSource, Property, TableMap
from .sources.triples import TripleSource, TripleStore

__all__ = ["Engine", "MappedSource", "Property", "TableMap", "TripleSource", "TripleStore"]
