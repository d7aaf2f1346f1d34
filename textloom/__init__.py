"""Context-aware search and corpus processing on Spark DataFrames."""

from textloom.plans.search import search
from textloom.plans.spec import SearchSpec

__all__ = ["SearchSpec", "search"]
