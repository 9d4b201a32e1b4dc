"""Benchmark decontamination: windows of words shared with a benchmark, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, join_keyed, let, read

#: A word is a run of these characters after A-Z were folded: digits, letters and all that isn't ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct windows are broadcast to every task as a hash table; more of them are joined by shuffle.
SET_WINDOWS = 200_000
#: A window is looked up by its first words, so many of them at most, before it is hashed as a whole.
HEAD = 3
#: Parts of a word are joined by this character, which no word holds.
JOINED = " "


def words(text: Column) -> Column:
    """The normalised words of a text in order; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _head(word, m: int) -> Column:
    """A hash of the first m words of a window; `word` gives them by number."""
    return F.xxhash64(*(word(j) for j in range(m)))


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, gram, width, h, head): distinct windows of each item, their hash, and the hash of their first words.

    An item of fewer than `size` words, but not none, is one window.
    """
    grams = lambda w: F.when(
        F.size(w) > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (size - 1))), lambda i: F.slice(w, i, size)),
    ).otherwise(F.array().cast("array<array<string>>"))
    out = items.select(F.col(id_col).alias("item_id"), F.explode(let(words(F.col(text_col)), grams)).alias("g"))
    head = _head(lambda j: F.get("g", F.lit(j)), HEAD)
    for m in range(1, HEAD):
        head = F.when(F.size("g") == m, _head(lambda j: F.get("g", F.lit(j)), m)).otherwise(head)
    return out.select("item_id", F.array_join("g", JOINED).alias("gram"), F.size("g").alias("width"), F.xxhash64("g").alias("h"), head.alias("head")).distinct()


def scan(docs: DataFrame, grams: DataFrame, columns: dict[str, Column], text_col: str, few: bool) -> DataFrame:
    """One row for each document (`columns`, n_words, pos 0) and one for each hit (pos, width, gram), told apart by `row`.

    A window starts where its first words stand, so each position is looked up by the hash of its next
    words; only positions that pass are hashed as whole windows, and those that pass again compared as
    text. With `few`, the caller has counted the windows: they are broadcast, and the documents, read
    once, aren't shuffled. Otherwise positions travel as hashes, and only those that pass meet their text again.
    """
    table = grams.select("gram", "width", "h", "head").distinct()
    heads = table.groupBy("head").agg(F.collect_set("width").alias("widths"))
    sizes = sorted({min(r[0], HEAD) for r in table.select("width").distinct().collect()}) or [HEAD]
    base = docs.select(F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in columns.items()), words(F.col(text_col)).alias("w"))
    if not few:
        base = cut(base)  # its row numbers are used twice
    # position 0 stands for the document; explode_outer, as explode would have Spark split each text twice
    at = base.select("*", F.explode_outer(F.sequence(F.lit(0), F.size("w"))).alias("pos"))
    keys = [_head(lambda j: F.get("w", F.col("pos") - 1 + j), m) for m in sizes]
    head = keys[0] if len(keys) == 1 else F.explode_outer(F.when(F.col("pos") > 0, F.array(*keys)).otherwise(F.array(F.lit(0).cast("long"))))
    fits = lambda df: df.where("pos + width <= size(w) + 1").withColumn("h", F.expr("if(width > 0, xxhash64(slice(w, pos, width)), null)"))
    same = lambda df: (df.h == table.h) & (df.width == table.width) & (F.array_join(F.slice("w", F.greatest("pos", F.lit(1)), df.width), JOINED) == table.gram)
    if few:
        own = heads.unionByName(docs.sparkSession.sql("select cast(null as long) as head, array(0) as widths"))
        places = at.withColumn("head", head).withColumn("head", F.when(F.col("pos") > 0, F.col("head")))
        met = places.join(F.broadcast(own), places["head"].eqNullSafe(own["head"]))
        found = fits(met.select("row", *columns, "w", "pos", F.explode_outer("widths").alias("width")))
        hits = found.join(F.broadcast(table), same(found), "left").where(F.col("gram").isNotNull() | (F.col("pos") == 0))
        return hits.select("row", *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in columns), F.when(F.col("pos") == 0, F.size("w").cast("long")).alias("n_words"), "pos", found.width, "gram")
    places = at.where("pos > 0").select("row", "pos", head.alias("head"))
    starts = join_keyed(places, cut(heads), "head", "inner").groupBy("row").agg(F.collect_set(F.struct("pos", "widths")).alias("starts"))
    some = base.select("row", "w").join(starts, "row").select("row", "w", F.explode("starts").alias("s")).select("row", "w", "s.pos", F.explode("s.widths").alias("width"))
    found = cut(fits(some).select("row", "pos", "width", "h", F.expr(f"array_join(slice(w, pos, width), '{JOINED}')").alias("gram")))
    hits = join_keyed(found, cut(table.select("h", "width", "gram")), ["h", "width", "gram"], "inner").select("row", "pos", "width", "gram").distinct()
    heads_of = base.select("row", *columns, F.size("w").cast("long").alias("n_words"), F.lit(0).alias("pos"), F.lit(0).alias("width"), F.lit(None).cast("string").alias("gram"))
    return heads_of.unionByName(hits, allowMissingColumns=True)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = 0.05, set_windows: int = SET_WINDOWS, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, the columns `extra` of `docs`, n_words, n_hit, n_items, items, spans, contaminated) for every row of `docs`.

    spans has the word ranges (start, end) inside occurring windows of the benchmark, merged; n_hit
    counts their words, n_items the items that have an occurring window, and items lists them, sorted as
    strings. A document is contaminated when n_hit > 0 and n_hit / n_words >= share.

    Null and empty texts have no words, and so no hits; items without words have no window. Windows that
    several items share count for each. Repeated rows of either table give repeated or the same results.
    An empty benchmark hits nothing. Columns of other names are ignored.
    """
    grams = cut(windows(benchmark, size, item_id_col, item_text_col))
    n = grams.select("gram").distinct().count()
    ids = {"doc_id": F.col(id_col)} | (extra or {})
    looked = cut(scan(docs, grams, ids, text_col, n <= set_windows))
    hits = looked.where("pos > 0")
    # positions covered by any window, in order: a range starts or ends where the one before or after is missing
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.col("width") - 1)))))
    starts = lambda c: F.filter(c, lambda p, i: (i == 0) | (F.get(c, i - 1) < p - 1))
    ends = lambda c: F.filter(c, lambda p, i: (i == F.size(c) - 1) | (F.get(c, i + 1) > p + 1))
    spans = let(F.col("c"), lambda c: F.struct(F.size(c).cast("long").alias("n_hit"), F.arrays_zip(starts(c).alias("start"), ends(c).alias("end")).alias("spans")))
    places = hits.groupBy("row").agg(covered.alias("c")).select("row", spans.alias("s")).select("row", "s.n_hit", "s.spans")
    pairs = cut(hits.select("row", "gram").distinct())
    named = join_keyed(pairs, grams.groupBy("gram").agg(F.collect_set("item_id").alias("ids")), "gram", "inner")
    items = named.select("row", F.explode("ids").alias("item_id")).groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = looked.where("pos = 0").select("row", *ids, "n_words").join(places.join(items, "row", "left"), "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        *ids,
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        ((hit > 0) & (hit >= share * F.col("n_words"))).alias("contaminated"),
    )


def remove_spans(text: Column, spans: Column) -> Column:
    """A text with the words in `spans` (of contamination()) taken out, the other words as they were, single-spaced."""
    end = lambda j: F.when(j > 0, F.get(spans, j - 1)["end"]).otherwise(0)
    start = lambda j, w: F.when(j < F.size(spans), F.get(spans, j)["start"]).otherwise(F.size(w) + 1)
    kept = lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda j: F.slice(w, end(j) + 1, F.greatest(F.lit(0), start(j, w) - end(j) - 1))))
    original = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.array_join(let(original, kept), " ")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    exact = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), exact.alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
QUERIES = {"op8_decontam": op8_decontam}
ORACLES = {
    "op8_decontam": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        grams AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS gram, least(13, len(w)) AS width
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
        placed AS (
            SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS gram
            FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
                  FROM d, (SELECT DISTINCT width FROM grams) WHERE len(w) >= width)),
        hits AS (SELECT doc_id, i, a.width, item_id FROM placed a JOIN grams g USING (gram)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
