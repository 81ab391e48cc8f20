"""Every query of the library, by importing the modules that register them."""

from . import corpus_queries, evaluation_queries, search_queries, service_queries, store_queries, stream_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
