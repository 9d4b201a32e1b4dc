"""Exact duplicates by deterministic block naming, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, join_keyed, read

#: Rows of block names that one task gets.
TASK_ROWS = 500_000


def _numbered(distinct: DataFrame, tasks: int, *order: str) -> DataFrame:
    """Distinct rows with an integer `name` each, which is their rank: it depends on the rows alone, not on how they are dealt.

    Rows are dealt by ranges and sorted; a row's rank is its number in its partition and the sizes of the
    partitions before it, a table with one row for each partition.
    """
    at = F.monotonically_increasing_id()
    placed = cut(distinct.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("*", at.alias("_at")))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = F.broadcast(cut(sizes.select("_part", before.alias("_before"))))
    return placed.join(offsets, part == offsets["_part"]).select(*distinct.columns, (within + F.col("_before")).alias("name"))


def _block_names(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(row, ix, name) of every block: equal blocks, and only they, have the same integer name.

    A name is the block's rank by its 64-bit hash and then its bytes; so that only the hash has to travel
    back to the documents, blocks are first grouped by it. Should a hash have two blocks, its documents'
    blocks are compared byte by byte.
    """
    sets = blocks.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("set"))
    shared = F.size("set") > 1
    distinct = cut(sets.select("h", shared.alias("shared"), F.explode("set").alias("block")).withColumn("block", F.expr("if(shared, block, null)")))
    names = _numbered(distinct, distinct.count() // TASK_ROWS + 1, "h", "block")
    flat = rows.select("row", F.posexplode("hashes").alias("ix", "h"))
    named = join_keyed(flat, names.where("not shared").select("h", "name"), "h", "inner").select("row", "ix", "name")
    several = names.where("shared").select("h", "block", "name")
    if distinct.where("shared").isEmpty():
        return named
    return named.unionByName(join_keyed(cut(blocks.join(several.select("h").distinct(), "h", "left_semi")), several, ["h", "block"], "inner").select("row", "ix", "name"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, normalise=None) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Each text is cut into blocks of `block_bytes` bytes of UTF-8. Distinct blocks are sorted and named
    by their rank; then adjacent names are paired and the distinct pairs sorted and named, level by level,
    until every document has one name. A name depends on the texts alone, not on their partitions. Documents have the same level and name just when their texts are
    identical: no step depends on hashes being free of collisions. Names are written to the checkpoint
    folder at each level, so a lost executor cannot change them.

    `normalise` maps the text column before comparing (by default texts are compared as they are).
    A null text counts as empty, and all empty texts are one group. Of equal texts the row with the
    largest doc_id is kept (nulls come last); of rows that also repeat the doc_id, one. Other columns
    are ignored, so they may have any name. `row` tells apart rows that repeat a doc_id.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    raw = (normalise(text) if normalise else text).cast("binary")
    cuts = F.expr(f"sequence(0, greatest(0, cast(ceil(length(raw) / {block_bytes}) as int) - 1))")
    piece = lambda i: F.substring("raw", i * block_bytes + 1, block_bytes)
    # rows are numbered once: texts that are read again could come in another order
    base = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw")))
    rows = cut(base.select("row", "doc_id", F.sha2("raw", 256).alias("text_sha256"), F.transform(cuts, lambda i: F.xxhash64(piece(i))).alias("hashes")))
    blocks = base.select("row", F.posexplode(F.transform(cuts, piece)).alias("ix", "block")).withColumn("h", F.xxhash64("block"))
    first = cut(_block_names(rows, blocks))

    level, done = 0, []
    current = first
    while True:
        tasks = current.count() // TASK_ROWS + 1  # each level has half the rows, of a few bytes
        last = current.groupBy("row").agg(F.max("ix").alias("last")).where("last > 0").select("row").coalesce(tasks)
        unfinished = cut(last)
        done.append(current.join(unfinished, "row", "left_anti").select("row", F.lit(level).alias("level"), "name"))
        if unfinished.isEmpty():
            break
        pairs = cut(
            current.join(unfinished, "row", "left_semi")
            .coalesce(tasks)
            .groupBy("row", F.expr("ix div 2").cast("int").alias("ix"))
            .agg(F.max(F.expr("if(ix % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(ix % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
            .coalesce(tasks)
        )
        names = _numbered(pairs.select("a", "b").distinct().coalesce(tasks), tasks, "a", "b")
        current = cut(join_keyed(pairs, names, ["a", "b"], "inner").coalesce(tasks).select("row", "ix", "name"))
        level += 1
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    named = cut(named.join(rows.select("row", "doc_id", "text_sha256"), "row"))
    groups = cut(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("keep"), F.count("*").alias("group_size")))
    joined = join_keyed(named, groups, ["level", "name"], "inner")
    return joined.select("row", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("keep.row")).alias("kept"), "text_sha256")


def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op5_dedup": op5_dedup}
ORACLES = {
    "op5_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
}
