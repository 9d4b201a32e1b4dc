"""Classifying texts by prototypes, term sets, Naive Bayes and distances; scores and triage of evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship

# ---- lexical prototypes ----


def bigram_rows(texts: DataFrame, id_col: str, text_col: str = "text", letters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., bigram): the distinct character bigrams of each text."""
    return texts.select(id_col, *keep, F.explode(T.bigrams(F.col(text_col), letters)).alias("bigram"))


def build_prototypes(rows: DataFrame, domain_col: str) -> DataFrame:
    return rows.select(F.col(domain_col).alias("domain"), "bigram").distinct()


def coverage(rows: DataFrame, prototypes: DataFrame, id_col: str) -> DataFrame:
    """(id, domain, coverage): the share of a text's bigrams that each domain's prototype has."""
    size = Window.partitionBy(id_col)
    sized = rows.select(id_col, "bigram", F.count("*").over(size).alias("n"))
    hits = sized.join(prototypes, "bigram").groupBy(id_col, "domain", "n").agg(F.count("*").alias("k"))
    return hits.select(id_col, "domain", (F.col("k") / F.col("n")).alias("coverage"))


def loo_thresholds(rows: DataFrame, domain_col: str, id_col: str) -> DataFrame:
    """(domain, samples, mean, threshold): each text's coverage by the other texts of its domain.

    A bigram of a text is covered by the others just when two texts of the domain have it. The threshold
    is the mean less two standard deviations of the population, and at least 0.01.
    """
    shared = rows.withColumn("df", F.count("*").over(Window.partitionBy(domain_col, "bigram")))
    each = shared.groupBy(domain_col, id_col).agg((F.count_if(F.col("df") >= 2) / F.count("*")).alias("c"))
    out = each.groupBy(domain_col).agg(F.count("*").alias("samples"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd"))
    return out.select(domain_col, "samples", "mean", F.greatest(F.lit(0.01), F.col("mean") - 2 * F.col("sd")).alias("threshold"))


def lexical_domains(cover: DataFrame, thresholds: DataFrame, id_col: str, ratio: float = 2.0) -> DataFrame:
    """(id, domain) of the domains that a text belongs to.

    None unless some domain reaches its threshold. The one with most coverage alone (even under its own
    threshold) if it has `ratio` times that of the second, or there is no second; else all that reach
    theirs. Ties go to the domain that sorts first.
    """
    w = Window.partitionBy(id_col).orderBy(F.desc("coverage"), "domain")
    ranked = cover.join(F.broadcast(thresholds), "domain").select(id_col, "domain", "coverage", (F.col("coverage") >= F.col("threshold")).alias("above"), F.row_number().over(w).alias("rank"))
    whole = Window.partitionBy(id_col)
    seen = ranked.withColumns({"any": F.bool_or("above").over(whole), "top": F.max(F.when(F.col("rank") == 1, F.col("coverage"))).over(whole), "second": F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("coverage"))).over(whole), F.lit(0.0))})
    alone = (F.col("second") == 0) | (F.col("top") >= F.col("second") * ratio)
    return seen.where(F.col("any") & F.when(alone, F.col("rank") == 1).otherwise(F.col("above"))).select(id_col, "domain")


def similar(prototypes: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, similarity) of domains whose sets of bigrams have that Jaccard similarity."""
    sized = prototypes.withColumn("n", F.count("*").over(Window.partitionBy("domain")))
    other = sized.select("bigram", F.col("domain").alias("b"), F.col("n").alias("nb"))
    both = sized.withColumnRenamed("domain", "a").join(other, "bigram").where("a < b").groupBy("a", "b", "n", "nb").agg(F.count("*").alias("k"))
    out = both.select("a", "b", (F.col("k") / (F.col("n") + F.col("nb") - F.col("k"))).alias("similarity"))
    return out.where(F.col("similarity") >= least)


# ---- term sets ----


def term_set_scores(text: Column, sets: dict[str, dict]) -> Column:
    """Map of domain to score: the share of its terms that occur, times its weight, less up to a half for
    terms against it, and 0.05 more from two terms on; of 0 to 1, and only scores above 0."""

    def score(cfg: dict) -> Column:
        positive, negative = cfg.get("positive", []), cfg.get("negative", [])
        hits = sum((text.contains(t).cast("int") for t in positive), F.lit(0))
        against = sum((text.contains(t).cast("int") for t in negative), F.lit(0))
        base = hits / float(max(len(positive), 1)) * cfg.get("weight", 1.0) - F.least(against / float(max(len(negative), 1)) * 0.5, F.lit(0.5))
        return F.least(F.greatest(base, F.lit(0.0)) + F.when(hits >= 2, 0.05).otherwise(0.0), F.lit(1.0)) if positive else F.lit(0.0)

    return F.map_filter(F.create_map(*(x for d, cfg in sets.items() for x in (F.lit(d), score(cfg).cast("double")))), lambda k, v: v > 0)


def term_set_domain(text: Column, sets: dict[str, dict], unknown: str = "未知") -> Column:
    """(domain, confidence): the best term set, unknown under 0.15; a second one within 0.10 lowers confidence."""
    entries = F.array_sort(F.transform(F.map_entries(term_set_scores(text, sets)), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("d"))))

    def pick(e: Column) -> Column:
        best, second = -F.get(e, F.lit(0))["s"], F.when(F.size(e) > 1, -F.get(e, F.lit(1))["s"])
        gap = best - second
        out = lambda d, c: F.struct(d.alias("domain"), c.alias("confidence"))
        close = out(F.when(best > 0.20, F.get(e, F.lit(0))["d"]).otherwise(unknown), F.least(0.3 + gap * 2, F.lit(0.65)))
        return F.when(F.size(e) == 0, out(F.lit(unknown), F.lit(0.0))).when(best < 0.15, out(F.lit(unknown), best)).when(F.coalesce(gap < 0.10, F.lit(False)), close).otherwise(out(F.get(e, F.lit(0))["d"], F.least(best + 0.15, F.lit(0.95))))

    return T.let(entries, pick)


# ---- Naive Bayes over presence, weighted by inverse document frequency when predicting ----


def nb_train(rows: DataFrame, class_col: str, id_col: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(class, gram, log_prob, idf) and (class, prior, unseen) from (id, class, gram) rows of distinct grams."""
    from .graph import reliable

    rows = reliable(rows.select(id_col, class_col, "gram"))  # counted in several ways
    n_docs = rows.select(id_col).distinct().count()
    df = rows.groupBy("gram").agg(F.count("*").alias("df"))
    vocabulary = df.count()
    per = rows.groupBy(class_col, "gram").agg(F.count("*").alias("k"))
    total = per.groupBy(class_col).agg(F.sum("k").alias("all"))
    prior = rows.select(class_col, id_col).distinct().groupBy(class_col).agg(F.log(F.count("*") / float(max(n_docs, 1))).alias("prior"))
    classes = total.join(prior, class_col).select(F.col(class_col).alias("class"), "prior", (F.col("all") + alpha * vocabulary).alias("mass"), F.log(alpha / (F.col("all") + alpha * vocabulary)).alias("unseen"))
    grams = per.withColumnRenamed(class_col, "class").join(classes, "class").join(df, "gram").select("class", "gram", F.log((F.col("k") + alpha) / F.col("mass")).alias("log_prob"), (F.log((n_docs + 1.0) / F.col("df")) + 1.0).alias("idf"))
    return grams, classes.drop("mass")


def nb_predict(rows: DataFrame, grams: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """(id, class): the class with the largest sum of prior and idf-weighted log-probabilities; grams outside the vocabulary are ignored."""
    idf = grams.select("gram", "idf").distinct()
    known = rows.join(idf, "gram")
    base = known.groupBy(id_col).agg(F.sum("idf").alias("all_idf"))
    # a class's sum is what all grams would give as unseen, corrected for those that it has seen
    seen = known.select(id_col, "gram").join(grams.join(classes, "class"), "gram").groupBy(id_col, "class").agg(F.sum(F.col("idf") * (F.col("log_prob") - F.col("unseen"))).alias("more"))
    scored = base.join(F.broadcast(classes)).join(seen, [id_col, "class"], "left").select(id_col, "class", (F.col("prior") + F.col("all_idf") * F.col("unseen") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return scored.groupBy(id_col).agg(F.max_by("class", F.struct("score", "class")).alias("class"))


# ---- distances and agreement ----


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Weights of a hybrid distance: numbers 1 to 6, numbers 7 to 10, and n-grams.
HYBRID = (0.30, 0.20, 0.50)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two maps of keys to weights; 0 if either has no length."""
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    norm = F.sqrt(square(a) * square(b))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def hybrid_distance(a: Column, b: Column, a_grams: Column | None = None, b_grams: Column | None = None) -> Column:
    """1 less the weighted similarities of the structural numbers, the other numbers and the n-grams, at least 0.

    Without n-grams (maps) of both, the whole vectors take their place.
    """
    whole = cosine(a, b)
    grams = whole if a_grams is None or b_grams is None else F.when((F.size(a_grams) > 0) & (F.size(b_grams) > 0), sparse_cosine(a_grams, b_grams)).otherwise(whole)
    part = lambda start, n: cosine(F.slice(a, start, n), F.slice(b, start, n))
    return F.greatest(F.lit(0.0), 1 - (HYBRID[0] * part(1, 6) + HYBRID[1] * part(7, 4) + HYBRID[2] * grams))


def adjusted_rand(rows: DataFrame, true_col: str, found_col: str) -> DataFrame:
    """(ari): agreement of two partitions, from their contingency table; 1 when both are one class or all singletons."""
    pairs = lambda c: c * (c - 1) / 2.0
    cells = rows.groupBy(true_col, found_col).agg(F.count("*").cast("double").alias("n"))
    a = cells.groupBy(true_col).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    b = cells.groupBy(found_col).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    one = both.join(F.broadcast(a)).join(F.broadcast(b))  # one row each
    expected = F.col("a") * F.col("b") / pairs(F.col("total"))
    most = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def mahalanobis_prototypes(vectors: DataFrame, class_col: str, vector_col: str) -> dict:
    """{class: (centroid, inverse covariance or None)}: sums and products are aggregated on the cluster, inverses taken on the driver.

    With fewer than two vectors the covariance is the identity; a singular one gives None (Euclid is
    used). Null vectors are left out.
    """
    rows = vectors.select(F.col(class_col).alias("c"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).dropna()

    def moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}  # one entry for each class that a task has seen
        for part in it:
            for c, group in part.groupby("c"):
                x = np.stack(group["v"].to_numpy())
                n, s, q = sums.get(c, (0, 0.0, 0.0))
                sums[c] = n + len(x), s + x.sum(axis=0), q + x.T @ x
        if sums:
            yield pd.DataFrame([(c, np.concatenate([[n], s, q.ravel()])) for c, (n, s, q) in sums.items()], columns=["c", "m"])

    ship(vectors.sparkSession)
    parts = rows.mapInPandas(moments, f"c {rows.schema['c'].dataType.simpleString()}, m array<double>").select("c", F.posexplode("m").alias("i", "x"))
    whole = parts.groupBy("c", "i").agg(F.sum("x").alias("x")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    out = {}
    for r in whole.collect():  # one row for each class
        m = np.array([x["x"] for x in r["m"]])
        n = int(m[0])
        width = int(round((np.sqrt(4 * len(m) - 3) - 1) / 2))  # 1 + width + width * width numbers
        mean, squares = m[1 : 1 + width] / n, m[1 + width :].reshape(width, width)
        cov = (squares - n * np.outer(mean, mean)) / (n - 1) if n >= 2 else np.eye(width)
        # a rank that holds for products of doubles
        full = np.linalg.matrix_rank(cov, tol=max(1e-300, np.abs(np.diag(cov)).max() * width * 1e-10)) == width
        out[r["c"]] = (mean, np.linalg.inv(cov) if full else None)
    return out


def _form(diff: Column, matrix: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(T.let(diff, lambda d: dot(d, F.transform(matrix, lambda r: dot(r, d)))), F.lit(0.0)))


def mahalanobis(vector: Column, prototype: tuple) -> Column:
    """Distance of a vector to one prototype."""
    mean, inverse = prototype
    matrix = np.eye(len(mean)) if inverse is None else inverse
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in matrix))
    return _form(F.transform(vector, lambda x, i: x.cast("double") - F.get(F.array(*(F.lit(float(m)) for m in mean)), i)), rows)


def mahalanobis_distances(vectors: DataFrame, prototypes: dict, class_col: str, vector_col: str) -> DataFrame:
    """The rows with `distance`: that of each vector to the prototype of its class."""
    table = [(c, mean.tolist(), (np.eye(len(mean)) if inverse is None else inverse).tolist()) for c, (mean, inverse) in prototypes.items()]
    kind = vectors.schema[class_col].dataType.simpleString()
    known = vectors.sparkSession.createDataFrame(table, f"_class {kind}, _mean array<double>, _matrix array<array<double>>")
    diff = F.zip_with(F.col(vector_col), F.col("_mean"), lambda x, m: x.cast("double") - m)
    rows = vectors.join(F.broadcast(known), F.col(class_col) == F.col("_class"))  # one row for each class
    return rows.withColumn("distance", _form(diff, F.col("_matrix"))).drop("_class", "_mean", "_matrix")


# ---- credibility, layers, triage ----

# Scores by kind.
SOURCE_TYPES = {"官方机构": 1.0, "学术期刊": 0.95, "行业标准": 0.9, "个人编写": 0.4, "LLM提取": 0.35, "未知": 0.2}
METHODS = {"manual": 1.0, "keyword_scan": 0.65, "llm_extract": 0.45, "conjecture_mine": 0.3}
VENUES = {"nature": 1.0, "science": 1.0, "q1": 0.85, "icml": 0.80, "q2": 0.65, "conference": 0.55, "arxiv": 0.30, "preprint": 0.30, "blog": 0.05, "unknown": 0.30}
STUDIES = {"meta_analysis": 1.0, "systematic_review": 0.95, "rct": 0.90, "cohort": 0.70, "case_control": 0.55, "observational": 0.40, "case_report": 0.15, "unknown": 0.30}
PAPER_METHODS = {"manual": 1.0, "structured_parse": 0.85, "llm_extract": 0.50, "keyword_scan": 0.35}
TRIAGE_METHODS = {"manual": 1.00, "structured": 0.95, "llm_extract": 0.60, "keyword_scan": 0.40, "conjecture_mine": 0.20}
SEVERITIES = {"error": 1.0, "warning": 0.6, "info": 0.3}
WEIGHTS = {"credibility": 1.0, "extraction": 0.8, "boundary": 1.2, "terms": 0.6, "entropy": 0.9, "severity": 0.5}
PASS_AT, EPSILON = 0.80, 0.15


def lookup(c: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def credibility(source_type: Column, method: Column, authority: Column, consistency: Column, cited: Column, verified: Column) -> Column:
    """A source's credibility of 0 to 1. Bonuses take weights in order, so a verification without citations counts 0.10, as citations do."""
    base = 0.30 * lookup(source_type, SOURCE_TYPES, 0.3) + 0.20 * lookup(method, METHODS, 0.3) + 0.20 * authority + 0.15 * consistency
    bonus = F.when(cited & verified, 0.1 * 0.2 + 0.1 * 0.25).when(cited, 0.1 * 0.2).when(verified, 0.1 * 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + bonus))


def citation_score(n: Column) -> Column:
    return F.when(n >= 1000, 1.0).when(n >= 100, 0.80).when(n >= 10, 0.50).when(n > 0, 0.30).otherwise(0.15)


def paper_credibility(venue: Column, citations: Column, study: Column, method: Column) -> Column:
    return lookup(F.lower(venue), VENUES, 0.30) * 0.40 + citation_score(citations) * 0.25 + lookup(F.lower(study), STUDIES, 0.30) * 0.20 + lookup(method, PAPER_METHODS, 0.50) * 0.15


def layer(score: Column) -> Column:
    return F.when(score >= 0.80, "L0_VALIDATED").when(score >= 0.55, "L1_CONJECTURE").when(score >= 0.25, "L2_SOURCE_UNCERTAIN").otherwise("L3_OUTER_POSSIBILITY")


def triage_signals(credible: Column, method: Column, rationale: Column, terms: Column, entropy: Column, severity: Column, generic: tuple[str, ...] = ()) -> dict[str, Column]:
    """Six signals of 0 to 1 for a failed row: how far its verdict can be trusted."""
    gap = F.regexp_extract(rationale, r"Gap:\s*([0-9.]+)\s*(?:年|月|日|天|元|万|%|％)", 1).try_cast("double")
    limit = F.coalesce(F.regexp_extract(rationale, r"(?:>=|<=|==|!=|>|<)\s*([0-9.]+)\s*(?:年|月|日|天|元|万|%|％)", 1).try_cast("double"), F.lit(0.0))
    eps = EPSILON * F.greatest(limit, F.lit(0.001))
    near = F.when(gap <= eps, gap / eps * 0.5).when(gap <= eps * 3, 0.5 + (gap - eps) / (2 * eps) * 0.3).otherwise(0.8 + F.least((gap - 3 * eps) / (10 * eps), F.lit(1.0)) * 0.2)
    n = F.size(terms)
    count = F.when(n == 1, 0.25).when(n == 2, 0.45).when(n <= 4, 0.45 + (n - 2) * 0.15).otherwise(0.75 + F.least((n - 5) * 0.05, F.lit(0.15)))
    plain = F.size(F.filter(terms, lambda t: t.isin(*generic) | (F.length(t) <= 1) if generic else F.length(t) <= 1))
    return {
        "credibility": F.when(credible < 0.3, 0.10 + credible / 0.3 * 0.05).when(credible < 0.6, 0.15 + (credible - 0.3) / 0.3 * 0.45).otherwise(0.60 + (credible - 0.6) / 0.4 * 0.40),
        "extraction": lookup(method, TRIAGE_METHODS, 0.30),
        "boundary": F.when(gap.isNull(), 1.0).otherwise(near),
        "terms": F.when(n <= 0, 0.05).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), count - plain / F.greatest(n, F.lit(1)) * 0.30))),
        "entropy": F.when(entropy < 0.3, 1.0).when(entropy < 0.7, 1.0 - (entropy - 0.3) / 0.4 * 0.8).otherwise(0.2 - (entropy - 0.7) / 0.3 * 0.2),
        "severity": lookup(F.lower(severity), SEVERITIES, 0.5),
    }


def triage_score(signals: dict[str, Column]) -> Column:
    return sum((signals[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())


def triage(status: Column, score: Column) -> Column:
    """PASS unless the row failed; then FAIL if its score is 0.80 or more, else NEEDS_REVIEW."""
    return F.when(status != "FAILED", "PASS").when(score >= PASS_AT, "FAIL").otherwise("NEEDS_REVIEW")
