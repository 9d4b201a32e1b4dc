"""URL filter: rules, and a character language-model ratio for the rest; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, hot_rows, join_keyed, read, scratch

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Longest n-gram of the models, in characters as they are. All n-grams that occur are kept, so the models grow with the table.
ORDER = 12
#: Hot n-grams are looked for among those of up to so many characters first.
SHORT = 3
#: Marks before and after a URL.
START, END = "\x02", "\x03"
#: Share of the held-out accepted URLs that calibration lets the models block, at most.
MISS = 0.01
#: One of so many URLs that a rule judges, by a hash, is held out of the models and calibrates them.
HELD_OUT = 5
#: Scores are rounded to so many decimals for calibration, so their histogram is bounded.
DECIMALS = 3


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a URL; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tested first, as it is added last
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each position of each URL and its end: the n-gram of full order that ends there.

    START stands before a URL, so that its first character has a context.
    """
    marked = urls.select(*keep, F.concat(F.lit(START * (ORDER - 1)), "url", F.lit(END)).alias("s"))
    at = F.expr(f"transform(sequence(1, length(s) - {ORDER - 1}), i -> substring(s, i, {ORDER}))")
    return marked.select(*keep, F.explode(at).alias("gram"))


def _tails(full: DataFrame, keep: list[str], context: bool = False, orders: tuple[int, int] = (1, ORDER)) -> DataFrame:
    """One row for each order k and each n-gram of full order: the hash of its last k characters, and of all of these but the last.

    N-grams of all orders are named by 64-bit hashes. Of n different ones, n * n / 2**65 pairs are expected to
    share a name, and so their counts: a few of a billion.
    """
    tail, before = (f"xxhash64(substring(gram, {ORDER} - k + 1, k - {less}))" for less in (0, 1))
    one = f"named_struct('k', k, 'tail', {tail}{f", 'context', {before}" if context else ''})"
    return full.select(*keep, F.explode(F.expr(f"transform(sequence({orders[0]}, {orders[1]}), k -> {one})")).alias("t")).select(*keep, "t.*")


def train(full: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(tail, good, bad, good_all, bad_all) of all n-grams of all orders that either class has seen, and the number of symbols.

    `full` has (gram, good, bad): n-grams of full order with their numbers in accepted and rejected URLs.
    good_all and bad_all count the context, which is all characters but the last. `keep` stores a table.
    """
    seen = full.where("good + bad > 0")
    counts = _tails(seen, ["good", "bad"], context=True).groupBy("context", "tail").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    whole = Window.partitionBy("context")  # one row for each character that follows it, so no key is hot
    model = counts.select("tail", "good", "bad", F.sum("good").over(whole).alias("good_all"), F.sum("bad").over(whole).alias("bad_all"))
    return keep(model), seen.select(F.substring("gram", ORDER, 1)).distinct().count()


def _hot_tails(full: DataFrame) -> DataFrame:
    """The tails that are hot among all tails of `full`: one is only if its own tails are, so few long ones have to be counted."""
    least = hot_rows(ORDER * full.count())
    counted = lambda df: df.groupBy("tail").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("tail")
    short = cut(counted(_tails(full, [], orders=(1, SHORT))))
    start = F.expr(f"xxhash64(substring(gram, {ORDER - SHORT + 1}, {SHORT}))")
    return short.unionByName(counted(_tails(full.join(F.broadcast(short), start == short["tail"], "left_semi"), [], orders=(SHORT + 1, ORDER))))


def deltas(full: DataFrame, model: DataFrame, symbols: int, prior: float = 4.0) -> DataFrame:
    """(name, delta) of n-grams of full order, by their hash: log-probability of the last character, accepted minus rejected.

    Each class has a variable-order model: the estimate after a context of k characters is its counts
    plus `prior` times the estimate after k - 1, down to a uniform one over the symbols seen and a new one;
    so a context is used as far as it was seen. The longest tail of the n-gram that either class has seen
    is used; an n-gram whose last character is new to both has no row, and counts as 0.
    """
    seen = join_keyed(_tails(full, ["at"]), model, "tail", "inner", _hot_tails(full)).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("k", "good", "bad", "good_all", "bad_all"))).alias("orders"))
    uniform = F.lit(1.0 / (symbols + 1))
    step = lambda p, x: F.struct(*(((x[c] + prior * p[c]) / (x[f"{c}_all"] + prior)).alias(c) for c in ("good", "bad")))
    value = F.aggregate("orders", F.struct(uniform.alias("good"), uniform.alias("bad")), step, lambda p: F.log(p["good"]) - F.log(p["bad"]))
    # the hash comes last: up to here the number travels, which has fewer bytes
    return seen.select("at", value.alias("delta")).join(full.select("at", F.xxhash64("gram").alias("name")), "at").select("name", "delta")


def score(kinds: DataFrame) -> DataFrame:
    """(url, score) of `kinds`: mean log-likelihood difference per character.

    `kinds` has (url, verdict, held, n): distinct URLs, the verdict of a rule or null, if they are held out of the models, and how many rows have them.
    N-grams are counted before they are joined, and only the hot ones of a join are broadcast.
    """
    with scratch(kinds.sparkSession) as keep:
        kinds = cut(kinds.withColumn("kind", F.monotonically_increasing_id()))
        n = lambda verdict: F.expr(f"if(verdict = '{verdict}' and not held, n, 0)")
        counted = _grams(kinds.withColumns({"good": n("allow"), "bad": n("block")}), "good", "bad").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        full = keep(counted.withColumn("at", F.monotonically_increasing_id()))
        known = keep(deltas(full, *train(full, keep)))
        places = _grams(kinds, "kind").select("kind", F.xxhash64("gram").alias("name"))
        sums = join_keyed(places, known, "name", "inner").groupBy("kind").agg(F.sum("delta").alias("sum"))
        scores = F.coalesce("sum", F.lit(0.0)) / (F.length("url") + 1)
        return cut(kinds.select("kind", "url").join(sums, "kind", "left").select("url", scores.alias("score")))


def threshold(judged: DataFrame, miss: float) -> float:
    """The score from which URLs are allowed, from held-out ones (verdict, score, n).

    It is where as large a share of the accepted ones lies below as of the rejected ones above, so that errors are balanced; or, if that
    would block more than `miss` of the accepted, the score below which that share of them lies. Scores are
    counted in a histogram of DECIMALS, which has a bounded number of rows. Without accepted ones it is 0.
    """
    n = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0))
    bars = judged.groupBy(F.round("score", DECIMALS).alias("at")).agg(n("allow").alias("good"), n("block").alias("bad"))
    upto, all_ = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    sums = bars.select("at", "good", "bad", F.sum("good").over(upto).alias("good_upto"), F.sum("bad").over(upto).alias("bad_upto"), F.sum("good").over(all_).alias("goods"), F.sum("bad").over(all_).alias("bads"))
    below = (F.col("good_upto") - F.col("good")) / F.col("goods")  # accepted ones that this threshold blocks
    above = F.coalesce((F.col("bads") - F.col("bad_upto") + F.col("bad")) / F.nullif(F.col("bads"), F.lit(0)), F.lit(0.0))
    balanced = F.min(F.when(below >= above, F.col("at")))
    missed = F.min(F.when(F.col("good_upto") > miss * F.col("goods"), F.col("at")))
    found = sums.where("goods > 0").agg(F.least(balanced, missed).alias("limit")).first()["limit"]
    return 0.0 if found is None else found


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, miss: float = MISS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of `pages`.

    A URL that a rule fits gets the verdict of the longest such rule. Of all such URLs of the table, counted
    as often as they occur, four fifths train a model of accepted and one of rejected URLs; the others, chosen by a hash of
    the URL, are scored like URLs that no model has seen, and set the threshold (see threshold()). Every other URL is
    allowed if its score is at least that.

    Null URLs and those without :// have empty host and path and no rule. Equal URLs get equal verdicts.
    If the rules accept or reject nothing in the table, there is no model to compare with, and every URL
    without a rule is allowed; if all URLs of one verdict are held out, all train the models, and the threshold is 0. Columns of other names are ignored.
    """
    rules = RULES if rules is None else rules
    host, path = host_path(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict}))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    kinds = cut(rows.groupBy("url", F.col("by_rule").alias("verdict")).agg(F.count("*").alias("n")).withColumn("held", held))
    labelled = kinds.where("verdict is not null")
    seen = {(r[0], r[1]) for r in labelled.select("verdict", "held").distinct().collect()}
    if not {("allow", False), ("block", False)} <= seen:
        # a verdict that few URLs have may be held out as a whole: then all train, and nothing is left to calibrate with
        kinds, labelled = kinds.withColumn("held", F.lit(False)), labelled.withColumn("held", F.lit(False))
    if {v for v, _ in seen} != {"allow", "block"}:
        scores, limit = kinds.select("url", F.lit(0.0).alias("score")), 0.0
    else:
        scores = score(kinds)
        limit = threshold(labelled.where("held").select("url", "verdict", "n").join(scores, "url"), miss)
    out = join_keyed(rows, scores, "url", "inner")
    by_score = F.when(F.round("score", DECIMALS) >= limit, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_score).alias("verdict"), "score")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


QUERIES = {"op10_urls": op10_urls}
ORACLES: dict[str, str] = {}
