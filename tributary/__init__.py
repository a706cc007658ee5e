"""Tributary: relations combined under arbitrary predicates, in batch and over streams, on Spark."""

from tributary.functions.predicate import Predicate
from tributary.plans.api import STRATEGIES, join, join_in_memory
from tributary.session import get_session

__all__ = ["STRATEGIES", "Predicate", "get_session", "join", "join_in_memory"]
