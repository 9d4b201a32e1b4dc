"""Learning from labelled rows: thresholds, incremental Naive Bayes, and scoring against expectations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

LEAST_SAMPLES = 3


def sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def soft_compare(value: Column, threshold: Column, operator: str, temperature: float = 1.0) -> Column:
    """How far a comparison holds, of 0 to 1; at least 0.001 of temperature."""
    t = max(temperature, 0.001)
    side = -1.0 if operator in ("<=", "<") else 1.0
    if operator in ("==", "!="):
        near = F.exp(-((value - threshold) * (value - threshold)) / (2 * t * t))
        return near if operator == "==" else 1 - near
    return sigmoid((value - threshold) * side / t)


def hinge(score: Column, target: Column, margin: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.lit(margin) - F.when(target == 1, score - 0.5).otherwise(0.5 - score))


def _descend(pdf: pd.DataFrame, operator: str, start: float, rate: float, rounds: int, temperature: float) -> tuple[float, float, float]:
    x, y, w = pdf["value"].to_numpy(float), pdf["target"].to_numpy(float), pdf["n"].to_numpy(float)
    side = -1.0 if operator in ("<=", "<") else 1.0
    sign = np.where(y == 1, 1.0, -1.0)

    def loss(theta: float) -> tuple[float, np.ndarray]:
        s = 1 / (1 + np.exp(-np.clip((x - theta) * side / temperature, -500, 500)))
        return float(np.average(np.maximum(0.0, 0.5 - sign * (s - 0.5)), weights=w)), s

    theta, best, best_loss = start, start, loss(start)[0]
    first = best_loss
    for _ in range(rounds):
        _, s = loss(theta)
        active = 0.5 - sign * (s - 0.5) > 0
        grad = float(np.average(active * sign * s * (1 - s) * side / temperature, weights=w))
        theta = float(np.clip(theta - rate * grad, max(0.1, start * 0.3), start * 3.0))
        now = loss(theta)[0]
        if now < best_loss - 1e-12:
            best, best_loss = theta, now
    return best, first, best_loss


def tune_thresholds(samples: DataFrame, operator: str = ">=", rate: float = 50.0, rounds: int = 200, temperature: float = 50.0) -> DataFrame:
    """(rule_id, start, threshold, loss_before, loss_after): thresholds moved down the hinge loss of soft comparisons.

    `samples` has (rule_id, start, value, target). A rule's distinct values are first counted, so a task
    gets one row for each value and target of a rule, not its samples. Rules with fewer than three
    samples are left out.
    """
    ship(samples.sparkSession)
    binned = samples.groupBy("rule_id", "start", F.round("value", 1).alias("value"), "target").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["n"].sum() < LEAST_SAMPLES:
            return pd.DataFrame(columns=["rule_id", "start", "threshold", "loss_before", "loss_after"])
        pdf = pdf.sort_values(["value", "target"])
        start = float(pdf["start"].iloc[0])
        got = _descend(pdf, operator, start, rate, rounds, temperature)
        return pd.DataFrame([[pdf["rule_id"].iloc[0], start, *(got[i] for i in (0, 1, 2))]], columns=["rule_id", "start", "threshold", "loss_before", "loss_after"])

    return binned.groupBy("rule_id").applyInPandas(run, "rule_id string, start double, threshold double, loss_before double, loss_after double")


def shift_probabilities(grams: DataFrame, feedback: DataFrame, rate: float = 0.05) -> DataFrame:
    """(class, gram, log_prob) after feedback (class, gram, n): a seen feature's probability moves to 1 by `rate`, n times; unseen ones stay."""
    rows = grams.join(feedback, ["class", "gram"], "left")
    p = F.exp("log_prob")
    moved = 1 - (1 - p) * F.pow(F.lit(1 - rate), F.col("n").cast("double"))
    return rows.select("class", "gram", F.when(F.col("n").isNotNull(), F.log(moved)).otherwise(F.col("log_prob")).alias("log_prob"))


def score(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Each expectation with what was found (missing: not applicable) and its class: correct, false_positive, false_negative or wrong."""
    rows = expected.join(found, keys, "left").withColumn("status", F.coalesce("status", F.lit("NOT_APPLICABLE")))
    kind = F.when(F.col("status") == F.col("expected"), "correct").when((F.col("status") == "FAILED") & (F.col("expected") != "FAILED"), "false_positive").when((F.col("status") != "FAILED") & (F.col("expected") == "FAILED"), "false_negative").otherwise("wrong")
    return rows.withColumn("outcome", kind)


def score_summary(scored: DataFrame, dim: str) -> DataFrame:
    """(dim, n, correct, accuracy, false_positives): by dim and in all (null)."""
    ok = F.count_if(F.col("outcome") == "correct")
    return scored.rollup(dim).agg(F.count("*").alias("n"), ok.alias("correct"), (ok / F.count("*")).alias("accuracy"), F.count_if(F.col("outcome") == "false_positive").alias("false_positives"))


def compare_paths(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): FIXED, REGRESSION, BOTH_WRONG or SAME of a second path against a first."""
    x = a.select(*keys, (F.col("outcome") == "correct").alias("ok1"))
    y = b.select(*keys, (F.col("outcome") == "correct").alias("ok2"))
    return x.join(y, keys).select(*keys, F.when(~F.col("ok1") & F.col("ok2"), "FIXED").when(F.col("ok1") & ~F.col("ok2"), "REGRESSION").when(~F.col("ok1"), "BOTH_WRONG").otherwise("SAME").alias("change"))
