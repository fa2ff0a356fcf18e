"""Lexical search analytics on Spark DataFrames."""

__version__ = "0.1.0"

from termlake.engine import Engine
from termlake.operators.index import LexicalIndex, build, load
from termlake.params import BM25Params
from termlake.plans.cache import ResultCache, memoized
from termlake.plans.compose import Step

__all__ = ["BM25Params", "Engine", "LexicalIndex", "ResultCache", "Step", "build", "load", "memoized"]
