"""What happens to evidence rows after rules were evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .rules import FAILED


def merged(evidence: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each (document, rule, status): the first row's values, with fragments and terms merged.

    Fragments are added, in rule order, as 300 characters so far, a line of ---, and 200 of the new one,
    unless the new one is contained already; terms are a union in order of first appearance.
    """
    join = lambda acc, f: F.when(acc.contains(f), acc).otherwise(F.concat(F.substring(acc, 1, 300), F.lit("\n---\n"), F.substring(f, 1, 200)))
    rows = evidence.groupBy(id_col, "rule_id", "status").agg(F.array_sort(F.collect_list(F.struct("rule_ix", "input_fragment", "matched_terms", "package_id", "severity", "rationale"))).alias("items"))
    first = F.col("items")[0]
    fragments = F.transform("items", lambda i: i["input_fragment"])
    return rows.select(
        id_col, "rule_id", "status", first["rule_ix"].alias("rule_ix"), first["package_id"].alias("package_id"), first["severity"].alias("severity"), first["rationale"].alias("rationale"),
        F.aggregate(F.slice(fragments, 2, F.greatest(F.size(fragments) - 1, F.lit(0))), F.get(fragments, F.lit(0)), join).alias("input_fragment"),
        F.array_distinct(F.flatten(F.transform("items", lambda i: i["matched_terms"]))).alias("matched_terms"),
    )


def merged_rows(verdicts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """merged() for rows of rules.judged(): no shuffle, as all verdicts of a document are in one row."""
    join = lambda acc, f: F.when(acc.contains(f), acc).otherwise(F.concat(F.substring(acc, 1, 300), F.lit("\n---\n"), F.substring(f, 1, 200)))
    key = lambda x: F.struct(x["rule_id"], x["v"]["status"].alias("status"))
    own = lambda all_, k: F.filter(all_, lambda x: (x["rule_id"] == k["rule_id"]) & (x["v"]["status"] == k["status"]))
    one = lambda xs: F.struct(
        xs[0]["rule_id"].alias("rule_id"), xs[0]["v"]["status"].alias("status"), xs[0]["rule_ix"].alias("rule_ix"), xs[0]["package_id"].alias("package_id"), xs[0]["v"]["rationale"].alias("rationale"),
        F.aggregate(F.slice(xs, 2, F.size(xs)), xs[0]["v"]["fragment"], lambda acc, x: join(acc, x["v"]["fragment"])).alias("input_fragment"),
        F.array_distinct(F.flatten(F.transform(xs, lambda x: x["v"]["matched_terms"]))).alias("matched_terms"),
    )
    groups = let(F.col("verdicts"), lambda all_: F.transform(F.array_distinct(F.transform(all_, key)), lambda k: let(own(all_, k), one)))
    return verdicts.select(id_col, F.explode_outer(groups).alias("m")).where("m.rule_id is not null").select(id_col, "m.*")


def first_n(evidence: DataFrame, n: int = 100, id_col: str = "doc_id") -> DataFrame:
    """The first n rows of each document in rule order: the limit on evidence is a feature of a report."""
    w = Window.partitionBy(id_col).orderBy("rule_ix", "status")
    return evidence.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def without_warnings(evidence: DataFrame) -> DataFrame:
    return evidence.where("severity <> 'warning'")


def conflicts(evidence: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs of rows of one document with the same fragment and different statuses.

    Rows are keyed by a digest of the fragment, so that the shuffle carries no long keys.
    """
    rows = evidence.select(id_col, "rule_ix", "rule_id", "package_id", "status", F.sha2("input_fragment", 256).alias("key"))
    other = rows.select(id_col, "key", *(F.col(c).alias(f"{c}_b") for c in ("rule_ix", "rule_id", "package_id", "status")))
    kind = F.when(F.col("package_id") == F.col("package_id_b"), "intra_package").otherwise("cross_package")
    pairs = rows.join(other, [id_col, "key"]).where("rule_ix < rule_ix_b and status <> status_b")
    return pairs.select(id_col, "rule_id", "rule_id_b", "status", "status_b", kind.alias("conflict_type"))


def conflict_rows(verdicts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """conflicts() for rows of rules.judged(): no join and no shuffle, as all verdicts of a document are in one row."""
    differ = lambda a, b: (a["rule_ix"] < b["rule_ix"]) & (a["v"]["fragment"] == b["v"]["fragment"]) & (a["v"]["status"] != b["v"]["status"])
    kind = lambda a, b: F.when(a["package_id"] == b["package_id"], "intra_package").otherwise("cross_package")
    pair = lambda a, b: F.struct(a["rule_id"].alias("rule_id"), b["rule_id"].alias("rule_id_b"), a["v"]["status"].alias("status"), b["v"]["status"].alias("status_b"), kind(a, b).alias("conflict_type"))
    pairs = let(F.col("verdicts"), lambda all_: F.flatten(F.transform(all_, lambda a: F.transform(F.filter(all_, lambda b: differ(a, b)), lambda b: pair(a, b)))))
    return verdicts.select(id_col, F.explode_outer(pairs).alias("p")).where("p.rule_id is not null").select(id_col, "p.*")


def overall(evidence: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """CONFLICTED for a document with a failed rule, else VALIDATED."""
    return evidence.groupBy(id_col).agg(F.when(F.bool_or(F.col("status") == FAILED), "CONFLICTED").otherwise("VALIDATED").alias("status"))


def rollup(evidence: DataFrame, *dims: str) -> DataFrame:
    """Counts of statuses by dims, with totals (a null dimension)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return evidence.rollup(*dims).agg(n("PASSED"), n("FAILED"), n("NOT_APPLICABLE"), F.count("*").alias("total"))


def inject(evidence: DataFrame, extracted: DataFrame, rules: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Evidence in which pre-extracted values replace the verdicts of numeric rules.

    `extracted` has (id, rule_id, value, operator_hint, confidence); `rules` has (rule_id, operator,
    expected). A null value with a confidence of at least 0.3 makes the rule not applicable, below that
    the verdict stays as it was; a value is compared by its own operator or else the rule's.
    """
    return injected(evidence.join(extracted, [id_col, "rule_id"], "left"), rules).select(evidence.columns)


def injected(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """inject() for evidence that has value, operator_hint and confidence in its rows."""
    rows = evidence.join(F.broadcast(rules), "rule_id", "left")
    op = F.coalesce("operator_hint", "operator")
    v, e = F.col("value"), F.col("expected")
    known = F.when(op == ">=", v >= e).when(op == "<=", v <= e).when(op == ">", v > e).when(op == "<", v < e).when(op == "==", v == e).when(op == "!=", v != e).otherwise(v >= e)
    status: Column = F.when(v.isNotNull(), F.when(known, "PASSED").otherwise("FAILED")).when(F.coalesce(F.col("confidence"), F.lit(0.0)) >= 0.3, "NOT_APPLICABLE").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(evidence.columns)
