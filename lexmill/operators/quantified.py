"""Constraints with quantifiers over tables: for all of a sort, a premise implies a comparison, with the witness that breaks it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


@dataclass(frozen=True)
class Sort:
    """The things that a variable ranges over: a table and the column that names them."""

    rows: DataFrame
    key: str


@dataclass(frozen=True)
class ForAll:
    """For all x of `sort`, and y of `other` with the same values in the columns `on`: premise implies conclusion.

    Without `other`, about x alone. Premise and conclusion are Columns over both rows; where a conclusion is null,
    nothing is known, and nothing is broken.
    """

    name: str
    sort: Sort
    premise: Column
    conclusion: Column
    other: Sort | None = None
    on: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Exists:
    """For all x of `sort` that fit the premise there is a y of `other` that fits the conclusion."""

    name: str
    sort: Sort
    premise: Column
    conclusion: Column
    other: Sort
    on: dict[str, str]


def numeric(name: str, sort: Sort, premise: Column, value: Column, operator: str, threshold: float) -> ForAll:
    """Everything that fits the premise has a value that compares so."""
    return ForAll(name, sort, premise, _COMPARE[operator](value, F.lit(threshold)))


def _paired(c: ForAll | Exists, how: str, condition: Column | None = None) -> DataFrame:
    on = None
    for mine, theirs in c.on.items():
        same = c.sort.rows[mine] == c.other.rows[theirs]
        on = same if on is None else on & same
    return c.sort.rows.join(c.other.rows, on if condition is None else on & condition, how)


def violations(c: ForAll | Exists) -> DataFrame:
    """(constraint, subject, witness): what breaks a constraint, and with which thing of the other sort (null if there is none).

    For all: the negation is a join with the premise and the broken conclusion as its condition. Exists: an
    anti-join, so a thing breaks it if nothing of the other sort fits; it has no witness.
    """
    name, subject = F.lit(c.name).alias("constraint"), c.sort.rows[c.sort.key].cast("string").alias("subject")
    if isinstance(c, Exists):
        fitting = _paired(Exists(c.name, Sort(c.sort.rows.where(c.premise), c.sort.key), c.premise, c.conclusion, c.other, c.on), "left_anti", c.conclusion)
        return fitting.select(name, subject, F.lit(None).cast("string").alias("witness"))
    if c.other is None:
        return c.sort.rows.where(c.premise & ~c.conclusion).select(name, subject, F.lit(None).cast("string").alias("witness"))
    return _paired(c, "inner", c.premise & ~c.conclusion).select(name, subject, c.other.rows[c.other.key].cast("string").alias("witness"))


def check(constraints: list[ForAll | Exists]) -> DataFrame:
    """(constraint, holds, broken_by, subject, witness): each constraint, how many pairs break it, and the smallest of them."""
    out = None
    for c in constraints:
        first = F.min(F.struct("subject", "witness"))
        one = violations(c).agg(F.count("*").alias("broken_by"), first.alias("w")).select(F.lit(c.name).alias("constraint"), (F.col("broken_by") == 0).alias("holds"), "broken_by", "w.subject", "w.witness")
        out = one if out is None else out.unionByName(one)
    return out


def proved(c: ForAll | Exists) -> bool:
    """Is the negation without a witness?"""
    return violations(c).isEmpty()
