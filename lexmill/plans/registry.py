"""All queries of the engine, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis_queries, clause_queries, gold, knowledge_queries, learned_queries, profile_queries, rule_queries

_MODULES = [rule_queries, clause_queries, analysis_queries, knowledge_queries, profile_queries, gold, learned_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence counted by rule and status."""
    return rule_queries.package_evidence(spark, sf_dir).groupBy("rule_id", "status").agg(F.count("*").alias("n"))
