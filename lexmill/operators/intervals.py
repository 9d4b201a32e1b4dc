"""Spans of texts that overlap, and what evidence leaves uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, running
from .graph import reliable

#: Characters of a bucket: spans meet in the buckets that both touch.
BUCKET = 512
#: Words that are broadcast at most; more of them are joined by a shuffle.
HOT = 500_000

# Limits of the regression of findings to rules.
RULE_SHARE, RULE_CONFIDENCE, CONJECTURE_SHARE, CONJECTURE_CONFIDENCE, NEW_RULE_CONFIDENCE = 0.8, 0.3, 0.5, 0.5, 0.6
FREQUENT, CROSS_BY, CROSS_MOST, SURE_BY, SURE_MOST = 2, 10, 0.5, 8, 0.6
PAIR_CROSS, PAIR_SURE, PAIR_REACH = 0.3, 0.25, 4


def _touched(df: DataFrame, bucket: int) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"greatest(start, `end` - 1) div {bucket}"))))


def _met(spans: DataFrame, others: DataFrame, by: str, bucket: int) -> DataFrame:
    """(by, start, end) of the spans that overlap a row of `others`, each once.

    A semi-join on the text and the buckets of offsets that a span touches, with the overlap as its condition: texts are dealt
    by bucket as well, so a long text with many spans isn't one task, and nothing is compared across buckets.
    """
    near = _touched(spans.select(by, "start", "end"), bucket).alias("a")
    far = _touched(others.select(by, "start", "end"), bucket).alias("b")
    meet = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return near.join(far, meet, "left_semi").select(by, "start", "end").distinct()


def touching(spans: DataFrame, others: DataFrame, by: str, bucket: int = BUCKET) -> DataFrame:
    """The rows of `spans` (by, start, end, ...) that overlap a row of `others` (by, start, end); ends are exclusive."""
    return spans.join(_met(spans, others, by, bucket), [by, "start", "end"], "left_semi")


def marked(spans: DataFrame, evidence: DataFrame, by: str, bucket: int = BUCKET) -> DataFrame:
    """All rows of `spans`, with whether evidence overlaps them as `covered`."""
    met = _met(spans, evidence, by, bucket).withColumn("_hit", F.lit(True))
    return spans.join(met, [by, "start", "end"], "left").withColumn("covered", F.col("_hit").isNotNull()).drop("_hit")


def uncovered(spans: DataFrame, evidence: DataFrame, by: str, bucket: int = BUCKET) -> DataFrame:
    """The rows of `spans` that no evidence overlaps."""
    return marked(spans, evidence, by, bucket).where("not covered").drop("covered")


def line_spans(text: Column) -> Column:
    """Array of (start, end, line) of the lines of a text that hold more than blanks, in characters."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def spans(p: Column) -> Column:
        starts = running(F.transform(p, lambda x: F.char_length(x) + 1))  # linear in the text's length
        return F.zip_with(p, starts, lambda x, at: F.struct(at.cast("long").alias("start"), (at + F.char_length(x)).cast("long").alias("end"), x.alias("line")))

    return F.filter(let(parts, spans), lambda s: F.trim(s["line"]) != "")


def outer_terms(covered: DataFrame, outer: DataFrame) -> DataFrame:
    """(term, frequency, cross_confidence, confidence): words that only spans without evidence have, FREQUENT times or more.

    Both have a column `terms`, an array of the words of a span.
    """
    known = covered.select(F.explode("terms").alias("term")).distinct()
    counts = outer.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= FREQUENT)
    only = counts.join(known, "term", "left_anti")
    return only.select("term", "frequency", F.least(F.lit(CROSS_MOST), F.col("frequency") / CROSS_BY).alias("cross_confidence"), F.least(F.lit(SURE_MOST), F.col("frequency") / SURE_BY).alias("confidence"))


def regression(nodes: DataFrame, rule_terms: DataFrame) -> DataFrame:
    """Findings (term parts as `terms`, confidence, cross_confidence) with `overlap`, `action` and `target`: do they go back to the rules?

    A finding whose terms a rule has nearly all asks to correct that rule; one with half of them and enough confidence
    becomes a conjecture; one that is confirmed across texts asks for a new rule; all others stay outside.
    `rule_terms` has (term); the target is the first of a finding's terms, by name, that a rule has.
    """
    rows = reliable(nodes.withColumn("_node", F.monotonically_increasing_id()))
    parts = rows.select("_node", F.explode(F.array_distinct("terms")).alias("term")).join(rule_terms.select("term").distinct(), "term").groupBy("_node").agg(F.count("*").alias("k"), F.min("term").alias("target"))
    both = rows.join(parts, "_node", "left").withColumn("overlap", F.coalesce(F.col("k"), F.lit(0)) / F.greatest(F.size(F.array_distinct("terms")), F.lit(1)))
    o, c, x = F.col("overlap"), F.col("confidence"), F.col("cross_confidence")
    action = F.when((o >= RULE_SHARE) & (x >= RULE_CONFIDENCE), "correct_rule").when((c >= CONJECTURE_CONFIDENCE) & (o >= CONJECTURE_SHARE), "upgrade_to_conjecture").when(x >= NEW_RULE_CONFIDENCE, "new_rule").otherwise("keep_outer")
    return both.withColumn("action", action).withColumn("target", F.when(F.col("action") == "correct_rule", F.col("target"))).drop("_node", "k")


def outer_pairs(outer: DataFrame, only: DataFrame, id_cols: list[str]) -> DataFrame:
    """(terms, cross_confidence, confidence): of each span of `outer`, the first two of its words within PAIR_REACH of each other of which `only` (term) has one.

    They follow from the first word that `only` has: the other one is the next if that word comes first, else the earliest
    within reach, so each word carries its other one and spans aren't put together again.
    """
    other = lambda i: F.get("terms", F.when(i == 0, 1).otherwise(F.greatest(i - PAIR_REACH, F.lit(0))))
    words = outer.select(*id_cols, F.inline(F.transform("terms", lambda t, i: F.struct(i.alias("pos"), t.alias("term"), other(i).alias("other")))))
    known = only.select("term").distinct()
    known = F.broadcast(known) if known.count() <= HOT else known
    first = words.join(known, "term").groupBy(*id_cols).agg(F.min(F.struct("pos", "term", "other")).alias("w")).select("w.*").where("other is not null")
    terms = F.when(F.col("pos") == 0, F.array("term", "other")).otherwise(F.array("other", "term"))
    return first.select(terms.alias("terms"), F.lit(PAIR_CROSS).alias("cross_confidence"), F.lit(PAIR_SURE).alias("confidence"))
