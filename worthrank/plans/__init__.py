"""Registered queries. Importing this package registers every query module."""

from worthrank.plans import (io_queries, learn_queries, model_queries, prepare_queries,  # noqa: F401
                             ranking_queries, training_queries, validation_queries)
from worthrank.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
