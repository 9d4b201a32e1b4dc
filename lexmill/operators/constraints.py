"""Numeric constraints on fields: checks, what-if, minimal conflicts, fixes, counterfactuals.

Every constraint is on one field, so satisfiability needs no solver: a bound field is compared, and an
unbound one is satisfiable when its largest lower bound leaves room under its smallest upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of legal references that make a constraint fatal, and of fields whose minimum is legal.
FATAL = "法|条例"
LEGAL_MINIMUM = "保修|质保"


def holds(value: Column, operator: Column, threshold: Column) -> Column:
    v, t = value, threshold
    return F.when(operator == ">=", v >= t).when(operator == "<=", v <= t).when(operator == ">", v > t).when(operator == "<", v < t).when(operator == "==", v == t).when(operator == "!=", v != t)


def gap(value: Column, operator: Column, threshold: Column) -> Column:
    return F.when(operator.isin(">=", ">"), threshold - value).when(operator.isin("<=", "<"), value - threshold).otherwise(F.abs(threshold - value))


def violations(propositions: DataFrame, constraints: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, field, value, operator, threshold, gap, legal_ref) of every violated constraint.

    All of them are given, not only those of one minimal core. Fields without a proposition, and unknown
    operators, violate nothing here.
    """
    rows = propositions.join(F.broadcast(constraints), "field")  # constraints are a rule package's
    bad = ~holds(F.col("value"), F.col("operator"), F.col("threshold"))
    return rows.where(bad).select(by, "field", "value", "operator", "threshold", gap(F.col("value"), F.col("operator"), F.col("threshold")).alias("gap"), "legal_ref")


def check(propositions: DataFrame, constraints: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, total, violated, verdict): UNDEFINED without constraints, else SATISFIABLE or VIOLATED."""
    n = constraints.count()
    bad = violations(propositions, constraints, by).groupBy(by).agg(F.count("*").alias("violated"))
    out = propositions.select(by).distinct().join(bad, by, "left").select(by, F.lit(n).cast("long").alias("total"), F.coalesce("violated", F.lit(0)).alias("violated"))
    return out.withColumn("verdict", F.when(F.col("total") == 0, "UNDEFINED").when(F.col("violated") == 0, "SATISFIABLE").otherwise("VIOLATED"))


def unbound_conflicts(constraints: DataFrame) -> DataFrame:
    """(field, low, high) of fields that no value can satisfy, whatever it is."""
    low = F.max(F.when(F.col("operator").isin(">=", ">", "=="), F.col("threshold")))
    high = F.min(F.when(F.col("operator").isin("<=", "<", "=="), F.col("threshold")))
    strict = F.bool_or(F.col("operator").isin(">", "<", "!="))
    out = constraints.groupBy("field").agg(low.alias("low"), high.alias("high"), strict.alias("strict"))
    return out.where((F.col("low") > F.col("high")) | ((F.col("low") == F.col("high")) & F.col("strict"))).select("field", "low", "high")


def what_if(propositions: DataFrame, constraints: DataFrame, field: str, by: str = "doc_id") -> DataFrame:
    """check() with a field changed: constraints on that field are dropped, so the new value is never tested."""
    return check(propositions.where(F.col("field") != field), constraints.where(F.col("field") != field), by)


def counterfactual(propositions: DataFrame, constraints: DataFrame, changes: dict[str, Column | None], by: str = "doc_id") -> DataFrame:
    """(by, field, fixed, broken, impact): what changing each proposition does to the constraints on it.

    `changes` gives the new value of a field as a Column over (value), or None: the proposition is removed, and then violates nothing.
    Each constraint is judged with the old and the new value in one row, so both sides come from one join. Fixed
    ones were violated before, broken ones are violated after; a fixed one counts half, a broken one minus one.
    """
    new = F.lit(None).cast("double")
    for field, change in changes.items():
        new = F.when(F.col("field") == field, change if change is not None else F.lit(None).cast("double")).otherwise(new)
    rows = propositions.where(F.col("field").isin(*changes)).withColumn("new", new).join(constraints, "field", "left")
    bad = lambda v: F.coalesce(~holds(F.col(v), F.col("operator"), F.col("threshold")), F.lit(False))
    fixed, broken = F.count_if(bad("value") & ~bad("new")), F.count_if(~bad("value") & bad("new"))
    return rows.groupBy(by, "field").agg(fixed.alias("fixed"), broken.alias("broken"), (fixed * 0.5 - broken).alias("impact"))


def minimal_conflicts(propositions: DataFrame, constraints: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, fields): minimal unsatisfiable sets. With a value, each violated constraint is one by itself."""
    return violations(propositions, constraints, by).select(by, F.array("field").alias("fields"), "operator", "threshold")


def fixes(propositions: DataFrame, constraints: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, field, threshold, suggested, rank): how violated constraints could be relaxed.

    To the actual value (half the threshold if that isn't positive); a legal minimum keeps its threshold
    and comes last; smaller changes first.
    """
    v, op, t = F.col("value"), F.col("operator"), F.col("threshold")
    legal = F.col("field").rlike(LEGAL_MINIMUM)
    new = F.when(legal, t).when(op.isin(">=", ">") & (v <= 0), t * 0.5).when(op == "!=", t + 0.1).otherwise(v)
    rows = violations(propositions, constraints, by).select(by, "field", "threshold", new.alias("suggested"), legal.cast("int").alias("legal"))
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("legal", F.abs(F.col("suggested") - F.col("threshold")), "field")
    return rows.select(by, "field", "threshold", "suggested", F.row_number().over(w).alias("rank"))


def report(violated: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, text): a line for each violation, in order of field."""
    line = F.format_string("%s: %s %s, actual %s (%s)", F.col("field"), F.col("operator"), F.col("threshold").cast("string"), F.col("value").cast("string"), F.col("legal_ref"))
    return violated.select(by, F.struct("field", line.alias("line")).alias("x")).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
