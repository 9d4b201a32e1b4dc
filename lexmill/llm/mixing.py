"""Mixing sources to target weights: iterative proportional fitting, then sampling."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, join_keyed, read

#: Cells of the table of margins that the driver rakes itself; a larger table is raked as a DataFrame.
DRIVER_CELLS = 100_000
ROUNDS = 200
#: Raking ends when all shares are as near to their targets as this.
TOLERANCE = 1e-9
#: Scales that one pass over a large table of cells tries.
STEPS = 64
#: Share of all tokens that sampling aims at.
KEEP_SHARE = 0.5
#: A margin's targets are its own shares raised to this power, unless they are given.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def word_count(text: Column) -> Column:
    """Words of a text, split at white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form, for tables without a column of topics: licence words, links or addresses, table bars, or plain prose."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    return F.when(low.contains("license") | low.contains("copyright"), "legal").when(t.contains("://") | t.contains("@"), "web").when(t.contains(" | "), "table").otherwise("prose")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): each value's share of tokens to a power, normalised."""
    margin = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("t")).where("t > 0")
    return margin.select(dim, (F.col("t") / margin.agg(F.sum("t")).first()[0]).alias("target")) if not margin.isEmpty() else margin.select(dim, F.col("t").alias("target"))


def _fill(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """The scale at which sum(min(tokens, scale * weight)) is the budget (infinite if that needs all tokens)."""
    used = weight > 0
    if budget >= tokens[used].sum():
        return float("inf")
    full = np.sort(tokens[used] / weight[used])
    order = np.argsort(tokens[used] / weight[used], kind="stable")
    t, w = tokens[used][order], weight[used][order]
    below, above = np.concatenate([[0.0], np.cumsum(t)])[:-1], w[::-1].cumsum()[::-1]
    scale = (budget - below) / above
    return float(scale[np.flatnonzero(scale <= full)[0]])


def _unmet(gap: float) -> None:
    if gap >= TOLERANCE:
        warnings.warn(f"raking has not met all targets after {ROUNDS} rounds: a share is off by {gap:.3g}", stacklevel=3)


def _rake_arrays(codes: dict[str, np.ndarray], tokens: np.ndarray, targets: dict[str, np.ndarray]) -> np.ndarray:
    w = tokens / max(tokens.sum(), 1)
    worst = 0.0
    for _ in range(ROUNDS):
        worst = 0.0
        for dim, target in targets.items():
            now = np.bincount(codes[dim], w, len(target))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, np.abs(now - target).max(initial=0.0))
            w = w * factor[codes[dim]]
        if worst < TOLERANCE:
            break
    _unmet(worst)
    return w


def _rake_frame(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """The same, for a table of any number of cells: each margin is one aggregation and one join."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now, gap = cells.withColumn("w", F.col("tokens") / total), 0.0
    for _ in range(ROUNDS):
        gap = 0.0
        for dim, target in targets.items():
            factors = cut(now.groupBy(dim).agg(F.sum("w").alias("sum")).join(target, dim))
            off = factors.agg(F.max(F.abs(F.col("sum") - F.col("target")))).first()[0] or 0.0
            gap = max(gap, off)
            now = join_keyed(now, factors.select(dim, F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("f")), dim).withColumn("w", F.col("w") * F.coalesce("f", F.lit(0.0))).drop("f")
            now = cut(now)
        if gap < TOLERANCE:
            break
    _unmet(gap)
    return now


def _fill_frame(raked: DataFrame, budget: float) -> float:
    """_fill() for a table of any number of cells: each pass over it sums STEPS scales, which narrow down the one."""
    used = raked.where("w > 0")
    low, high, whole = used.agg(F.lit(0.0), F.max(F.col("tokens") / F.col("w")), F.sum("tokens")).first()
    if high is None or budget >= whole:
        return float("inf")
    while high - low > 1e-13 * high:
        scales = np.linspace(low, high, STEPS + 1)
        kept = used.agg(*(F.sum(F.least(F.col("tokens").cast("double"), float(x) * F.col("w"))) for x in scales)).first()
        at = min(int(np.searchsorted(np.array(kept), budget)), STEPS)
        narrower = float(scales[max(0, at - 1)]), float(scales[at])
        if narrower == (low, high):
            break
        low, high = narrower
    return high


def mix(docs: DataFrame, dims: dict[str, Column], targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", keep_share: float = KEEP_SHARE, seed: int = 7, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """All rows and columns of `docs` with mix_tokens, mix_weight, mix_probability and mix_sampled.

    Tokens (words) are summed by the values of `dims`. Iterative proportional fitting scales the cells
    until each dimension has its target shares: those given, or else its own to a power (POWERS).
    Values without a given target get none of the mixture; targets of values without tokens are shared
    out among the others in proportion. A warning tells of targets that contradict each other. A cell's weight is its raked share over its
    share of tokens; documents of a cell are sampled with probability min(1, scale * weight), with one
    scale for which `keep_share` of all tokens are expected. The draw depends only on id, text and `seed`.

    Null values of a dimension are a value of their own (written as an empty string, like it); null and
    empty texts have no tokens and are never sampled. Rows that repeat id and text get the same draw. With no
    tokens at all nothing is sampled. Columns named like the results (mix_tokens, mix_weight, mix_probability,
    mix_sampled, and mix_ with a dimension) are replaced; all others stay, whatever their names.
    """
    prefix = "_mix"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names = {d: f"{prefix}_{d}" for d in dims}
    n_tokens, weight, chance = (f"{prefix} {x}" for x in ("tokens", "weight", "probability"))
    base = docs.withColumns({**{names[d]: F.coalesce(c.cast("string"), F.lit("")) for d, c in dims.items()}, n_tokens: word_count(F.col(text_col))})
    keys = list(names.values())
    cells = cut(base.groupBy(*keys).agg(F.sum(n_tokens).alias("tokens")).where("tokens > 0"))
    given = targets or {}
    spark = docs.sparkSession

    def target_frame(d: str) -> DataFrame:
        if d not in given:
            return tempered(cells, names[d], POWERS.get(d, 1.0))
        wanted = spark.createDataFrame([(k, float(v)) for k, v in given[d].items()], f"{names[d]} string, target double")
        there = wanted.join(cells.select(names[d]).distinct(), names[d], "left_semi")
        whole = there.agg(F.sum("target")).first()[0]
        return there.withColumn("target", F.col("target") / whole) if whole else there

    frames = {names[d]: target_frame(d) for d in dims}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if cells.count() <= driver_cells:
        rows = cells.orderBy(*keys).toPandas()
        codes, goals = {}, {}
        for k, f in frames.items():
            values, codes[k] = np.unique(rows[k].to_numpy(dtype=object).astype(str), return_inverse=True)
            goal = {r[0]: r[1] for r in f.collect()}  # values of one dimension: no more than cells
            goals[k] = np.array([goal.get(v, 0.0) for v in values])
        tokens = rows["tokens"].to_numpy(dtype=float)
        w = _rake_arrays(codes, tokens, goals) if len(rows) else np.zeros(0)
        scale = _fill(tokens, w, keep_share * total) if len(rows) else 0.0
        p = np.where(w > 0, np.minimum(1.0, (scale if np.isfinite(scale) else 1e300) * w / tokens), 0.0)
        rows = rows.assign(**{weight: w * total / tokens, chance: p})[[*keys, weight, chance]]
        schema = ", ".join([*(f"`{k}` string" for k in keys), f"`{weight}` double", f"`{chance}` double"])
        out = base.join(F.broadcast(spark.createDataFrame(rows.values.tolist(), schema)), keys, "left")  # DRIVER_CELLS rows at most
    else:
        raked = cut(_rake_frame(cells, frames))
        scale = min(_fill_frame(raked, keep_share * total), 1e300)
        p = F.when(F.col("w") > 0, F.least(F.lit(1.0), scale * F.col("w") / F.col("tokens"))).otherwise(0.0)
        raked = raked.select(*keys, (F.col("w") * total / F.col("tokens")).alias(weight), p.alias(chance))
        out = join_keyed(base, raked, keys)
    draw = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    out = out.withColumn(chance, F.when(F.col(n_tokens) > 0, F.coalesce(F.col(chance), F.lit(0.0))).otherwise(0.0))
    results = {**{f"mix_{d}": F.col(names[d]) for d in dims}, "mix_tokens": F.col(n_tokens), "mix_weight": F.coalesce(F.col(weight), F.lit(0.0)), "mix_probability": F.col(chance), "mix_sampled": draw < F.col(chance)}
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in results), *(c.alias(k) for k, c in results.items()))


def dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), dimensions())
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_sampled").alias("sampled"))


QUERIES = {"op4_mix": op4_mix}
ORACLES: dict[str, str] = {}
