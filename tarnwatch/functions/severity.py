"""The one severity order of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity order and the weights of the two risk formulas.
RANK = {"none": 0, "info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}
SUM_WEIGHT = {"low": 1.0, "medium": 3.0, "high": 7.0, "critical": 10.0}
MAX_WEIGHT = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 2.0, "info": 0.5}


def lookup(col: Column, values: dict, default=None) -> Column:
    """A CASE over a short fixed dictionary; unknown keys give the default."""
    out = None
    for key, value in values.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


def rank(col: Column) -> Column:
    return lookup(col, RANK, 0)


def from_rank(col: Column) -> Column:
    return lookup(col, {v: k for k, v in RANK.items()}, "none")


def ladder(score: Column, steps: list[tuple[float, str]], otherwise: str = "low") -> Column:
    """The label of the first step whose minimum the score reaches; steps fall."""
    out = None
    for least, label in steps:
        out = F.when(score >= least, label) if out is None else out.when(score >= least, label)
    return out.otherwise(otherwise)
