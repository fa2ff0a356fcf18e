"""Composable steps, lifting of functions, and unfolding of state spaces.

States are rows. A state space is unfolded level by level: one level's rows give the next one's, and each level is written
to shared storage, so its cost doesn't grow with the depth. There is no set of visited states: a state that is reached
twice is there twice, so a depth must be given.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.storage import stored


class Step:
    """A function, of a DataFrame or anything else, that composes: ``(f >> g)(x)`` is ``g(f(x))``."""

    def __init__(self, run: Callable):
        self.run = run

    def __call__(self, x):
        return self.run(x)

    def __rshift__(self, after: Callable) -> Step:
        return Step(lambda x: after(self(x)))


identity = Step(lambda x: x)


def chain(*steps: Callable) -> Step:
    return reduce(lambda f, g: f >> g, steps, identity)


def over_list(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``f`` on each element of an array column."""
    return lambda values: F.transform(values, f)


def over_optional(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``f`` where there is a value; null stays null whatever ``f`` makes of it."""
    return lambda value: F.when(value.isNotNull(), f(value))


class Lift(ABC):
    """Takes a function of values to one of structures of them; lifting keeps identity and composition."""

    @abstractmethod
    def __call__(self, f: Callable) -> Callable: ...


class ListLift(Lift):
    """To array columns."""

    def __call__(self, f):
        return over_list(f)


class OptionalLift(Lift):
    """To columns that may be null."""

    def __call__(self, f):
        return over_optional(f)


class TreeLift(Lift):
    """To trees kept as rows."""

    def __call__(self, f):
        return lambda tree: over_tree(tree, f)


def over_tree(tree: DataFrame, f: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """``f`` on the values of a tree's nodes, kept as rows (node, parent, depth, value); its shape stays."""
    return tree.withColumn(value, f(F.col(value)))


def unfold(roots: DataFrame, successors: Callable[[Column], Column], depth: int, terminal: Callable[[Column], Column] | None = None) -> DataFrame:
    """``root, depth, parent, value``: all states down to ``depth`` from ``roots`` (value).

    ``successors`` gives an array of the states after a state; a ``terminal`` state has none. The root's parent is null. A depth of
    0 or less gives the roots.
    """
    level = roots.select(F.col("value").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast(roots.schema["value"].dataType).alias("parent"), "value")
    levels = [level]
    for at in range(1, depth + 1):
        grow = level if terminal is None else level.where(~F.coalesce(terminal(F.col("value")), F.lit(False)))
        level = stored(grow.select("root", F.lit(at).cast("bigint").alias("depth"), F.col("value").alias("parent"), F.explode(successors(F.col("value"))).alias("value")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def unfold_edges(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """As ``unfold``, with successors from a table of edges (parent, value)."""
    level = roots.select(F.col("value").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast(roots.schema["value"].dataType).alias("parent"), "value")
    levels = [level]
    for at in range(1, depth + 1):
        here = level.select("root", F.col("value").alias("parent"))
        level = stored(here.join(edges.select("parent", "value"), "parent").select("root", F.lit(at).cast("bigint").alias("depth"), "parent", "value"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def trajectory(states: DataFrame, step: Callable[[Column], Column], steps: int) -> DataFrame:
    """``start, n, value``: the states (value) and what ``n`` = 1 .. ``steps`` steps make of each; in the row, without any join."""
    path = [F.col("value")]
    for _ in range(max(0, steps)):
        path.append(step(path[-1]))
    return states.select(F.col("value").alias("start"), F.posexplode(F.array(*path)).alias("n", "value")).select("start", F.col("n").cast("bigint").alias("n"), "value")
