"""All registered queries of the library."""

from quarry.queries import checks, corpus, governed, paper, sales, store, trails
from quarry.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "checks", "corpus", "governed", "paper", "sales", "store", "trails"]
