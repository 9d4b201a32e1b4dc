"""Mining runs and texts: associations, synonyms, vocabulary, fused and contradictory evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reliable

MIN_SUPPORT, MIN_LIFT, MIN_COUNT, MIN_RUNS = 0.10, 2.0, 3, 3
SYNONYM_SHARE = 0.6


def _frequent(terms: DataFrame, run_col: str, term_col: str, least: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """(terms, sets, n) of n runs: the frequent terms (term, k), and each run's frequent terms as one sorted array.

    A term that reaches MIN_SUPPORT (and `least`) in runs has at least as many rows, so rows are counted first, which shuffles a row
    for each term of a task; only rows of such terms go on, as one array for each run and task. They are broadcast: each has a tenth as many rows as there are runs, so there are at most ten times the rows of a mean run.
    """
    t = terms.select(F.col(run_col).alias("run"), F.lower(F.trim(F.col(term_col))).alias("term")).where("term <> ''")
    n = t.select("run").distinct().count()
    if n < MIN_RUNS:
        n = 0
    enough = lambda c: (F.col(c) >= least) & (F.col(c) >= MIN_SUPPORT * n) & F.lit(n > 0)
    likely = t.groupBy("term").agg(F.count("*").alias("rows")).where(enough("rows")).select("term")
    sets = reliable(t.join(F.broadcast(likely), "term").groupBy("run").agg(F.collect_set("term").alias("terms")).select(F.array_sort("terms").alias("terms")))
    k = reliable(sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("k")).where(enough("k")))
    return k, sets, n


def _together(sets: DataFrame, k: DataFrame) -> DataFrame:
    """(a, b, n) of frequent terms that meet in n runs, a before b; pairs are made in the row of a run and counted before they are shuffled."""
    pairs = F.flatten(F.transform("terms", lambda a, i: F.transform(F.slice("terms", i + 2, F.size("terms")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return counts.join(k.select(F.col("term").alias("a")), "a", "left_semi").join(k.select(F.col("term").alias("b")), "b", "left_semi")


def positive(terms: DataFrame, run_col: str = "run_id", term_col: str = "term") -> DataFrame:
    """(a, b, n, support, confidence, lift) of pairs of terms that occur together in runs far more often than by chance.

    Only terms frequent enough to reach the least support can be in such a pair, so others are dropped
    before pairs are made. None with fewer than three runs.
    """
    k, sets, n = _frequent(terms, run_col, term_col, MIN_COUNT)
    out = _together(sets, k).join(k.select(F.col("term").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("term").alias("b"), F.col("k").alias("kb")), "b")
    total = float(max(n, 1))
    out = out.select("a", "b", "n", (F.col("n") / total).alias("support"), (F.col("n") / F.col("ka")).alias("confidence"), ((F.col("n") / F.col("ka")) / (F.col("kb") / total)).alias("lift"))
    return out.where((F.col("support") >= MIN_SUPPORT) & (F.col("lift") >= MIN_LIFT) & (F.col("n") >= MIN_COUNT))


def negative(terms: DataFrame, run_col: str = "run_id", term_col: str = "term") -> DataFrame:
    """(a, b, ka, kb) of pairs of terms that are both frequent in runs and never occur together.

    The frequent terms have a bounded number of pairs: a term needs a tenth of all runs.
    """
    k, sets, _ = _frequent(terms, run_col, term_col)
    pairs = k.select(F.col("term").alias("a"), F.col("k").alias("ka")).join(k.select(F.col("term").alias("b"), F.col("k").alias("kb")), F.col("a") < F.col("b"))
    return pairs.join(_together(sets, k), ["a", "b"], "left_anti")


def as_rules(pairs: DataFrame, kind: str) -> DataFrame:
    """(rule_id, condition_type, terms, threshold) of mined pairs."""
    return pairs.select(F.concat_ws("+", F.lit(kind), "a", "b").alias("rule_id"), F.lit(kind).alias("condition_type"), F.array("a", "b").alias("terms"), F.when(F.lit(kind) == "mutual_exclusion", 2).alias("threshold"))


def chi_squared(o11: Column, o12: Column, o21: Column, o22: Column) -> tuple[Column, Column]:
    """Chi-squared of a 2x2 table with Yates' correction, and its p-value; (0, 1) with an empty margin."""
    o11, o12, o21, o22 = (c.cast("double") for c in (o11, o12, o21, o22))
    n, r1, r2, c1, c2 = o11 + o12 + o21 + o22, o11 + o12, o21 + o22, o11 + o21, o12 + o22
    part = lambda o, r, c: F.pow(F.abs(o - r * c / n) - 0.5, F.lit(2.0)) / (r * c / n)
    chi = F.when((r1 > 0) & (r2 > 0) & (c1 > 0) & (c2 > 0), part(o11, r1, c1) + part(o12, r1, c2) + part(o21, r2, c1) + part(o22, r2, c2)).otherwise(0.0)
    x = F.sqrt(chi)
    t = 1.0 / (1.0 + 0.2316419 * x)
    # coefficients of the polynomial approximation of the normal tail; fixed values
    tail = 0.3989422804014327 * F.exp(-x * x / 2.0) * (t * (0.319381530 + t * (-0.356563782 + t * (1.477937 + t * (-1.821255978 + t * 1.330274429)))))
    return chi, F.when(chi > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * tail))).otherwise(1.0)


def cohesion(grams: DataFrame, chars: DataFrame) -> DataFrame:
    """(bigram, n, pmi) from counts (bigram, n) and (char, n): log2 of how much likelier than by chance its characters meet."""
    total_b, total_c = grams.agg(F.sum("n").cast("double").alias("tb")), chars.agg(F.sum("n").cast("double").alias("tc"))
    first, second = (chars.select(F.col("char").alias(k), F.col("n").alias(f"n_{k}")) for k in ("x", "y"))
    rows = grams.select("bigram", "n", F.substring("bigram", 1, 1).alias("x"), F.substring("bigram", 2, 1).alias("y")).join(first, "x").join(second, "y")
    one = rows.join(F.broadcast(total_b)).join(F.broadcast(total_c))  # one row each
    return one.select("bigram", "n", F.log2((F.col("n") / F.col("tb")) / ((F.col("n_x") / F.col("tc")) * (F.col("n_y") / F.col("tc")))).alias("pmi"))


def spread(counts: DataFrame, term_col: str, slice_col: str, n_slices: int) -> DataFrame:
    """(term, distribution): normalised entropy of a term's counts over slices; 1 when it is in all alike."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(term_col))
    rows = counts.groupBy(term_col, slice_col).agg(F.sum("n").alias("n")).withColumn("p", p)
    import math

    return rows.groupBy(term_col).agg((F.sum(-F.col("p") * F.log2("p")) / (math.log2(n_slices) if n_slices > 1 else 1.0)).alias("distribution"))


def vocabulary(cohesive: DataFrame, spreads: DataFrame, n: int = 200) -> DataFrame:
    """The n terms of the largest log(count + 1) * log(cohesion) * distribution; a top list is the feature."""
    out = cohesive.join(spreads, "bigram").where("pmi > 0")
    score = F.log(F.col("n") + 1.0) * F.log("pmi") * F.col("distribution")
    return out.select("bigram", "n", "pmi", "distribution", score.alias("score")).orderBy(F.desc("score"), "bigram").limit(n)


def group_cooccurrence(evidence: DataFrame, groups: DataFrame, least: float = SYNONYM_SHARE) -> DataFrame:
    """(term, group, share): groups that a term outside all groups keeps company with.

    Each evidence row counts once for a term and each group of its other terms; counts are relative to
    the term's largest. `evidence` has (ev_id, term), `groups` has (group, term).
    """
    t = evidence.select("ev_id", F.lower(F.trim("term")).alias("term")).where("term <> ''")
    known = groups.groupBy(F.lower("term").alias("term")).agg(F.collect_set("group").alias("groups"))
    rows = t.join(F.broadcast(known), "term", "left")  # an ontology's terms
    # the terms of an evidence row are put together in the task that has them, and go through one shuffle
    free = F.when(F.col("groups").isNull() & (F.length("term") >= 2), F.col("term"))
    one = rows.groupBy("ev_id").agg(F.collect_set(free).alias("free"), F.array_distinct(F.flatten(F.collect_set("groups"))).alias("groups")).where(F.size("groups") > 0)
    each = one.select(F.explode("free").alias("term"), "groups").select("term", F.explode("groups").alias("group"))
    counts = each.groupBy("term", "group").agg(F.count("*").alias("n"))
    share = F.col("n") / F.greatest(F.max("n").over(Window.partitionBy("term")), F.lit(1))
    return counts.select("term", "group", share.alias("share")).where(F.col("share") >= least)


def fuse(model: DataFrame, regex: DataFrame, keys: list[str]) -> DataFrame:
    """Values found by a model (value, confidence) and by patterns (value), by field; agreement within 0.01 raises both confidences by a fifth."""
    m = model.select(*keys, F.col("value").alias("model_value"), F.col("confidence").alias("mc"))
    r = regex.select(*keys, F.col("value").alias("regex_value"), F.lit(0.95).alias("rc"))
    out = m.join(r, keys, "full_outer")
    agree = F.coalesce(F.abs(F.col("model_value") - F.col("regex_value")) < 0.01, F.lit(False))
    raised = lambda c: F.when(agree, F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) * 1.2)).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return out.select(*keys, "model_value", "regex_value", agree.alias("agreement"), raised("mc").alias("model_confidence"), raised("rc").alias("regex_confidence"))


def contradictions(claims: DataFrame) -> DataFrame:
    """(a, b, subject) of claims (claim_id, paper_id, subject, direction) of different papers on one subject in opposite directions."""
    c = claims.where("direction <> 0").select("claim_id", "paper_id", "direction", F.explode(F.array_distinct("subjects")).alias("subject"))
    other = c.select("subject", *(F.col(k).alias(f"{k}2") for k in ("claim_id", "paper_id", "direction")))
    pairs = c.join(other, "subject").where("paper_id < paper_id2 and direction = -direction2")
    return pairs.groupBy(F.col("claim_id").alias("a"), F.col("claim_id2").alias("b")).agg(F.min("subject").alias("subject"))


def outer_sentences(sentences: DataFrame, fragments: DataFrame, least_chars: int = 8, least_count: int = 2) -> DataFrame:
    """(sentence, n) of sentences that occur repeatedly and that no evidence fragment of their document has."""
    rows = sentences.where(F.length("sentence") >= least_chars)
    free = rows.join(fragments, (rows.doc_id == fragments.doc_id) & fragments.fragment.contains(rows.sentence), "left_anti")
    return free.groupBy("sentence").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def term_overlap(a: Column, b: Column) -> Column:
    """0.4 of the Jaccard similarity of characters and 0.6 of that of bigrams; 0 for an empty second text."""
    chars = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    grams = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))
    pairs = lambda s: F.filter(grams(s), lambda g: F.length(g) == 2)
    jaccard = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when(F.length(b) == 0, 0.0).otherwise(jaccard(chars(a), chars(b)) * 0.4 + jaccard(pairs(a), pairs(b)) * 0.6)
