"""A Merkle manifest of a table: one tree a group, one tree of their roots, and proofs by coordinate lookup."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, hot_rows, join_keyed, read, scratch
from .exact_dedup import _numbered

#: Children of a node.
FANOUT = 8
#: Leaves that one task sorts.
TASK_ROWS = 500_000
#: Nodes of the upper levels that are broadcast; more than so many are joined by shuffle.
UPPER_NODES = 32_768


def field(c: Column) -> Column:
    """A field of a leaf: `-` for null, else its length in UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _tasks(rows: int) -> int:
    return rows // TASK_ROWS + 1


def _levels(nodes: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], list[int]]:
    """Tables of nodes (tree, ix, n, hash), a level each from the leaves on, and their sizes; n counts the nodes of the tree's level.

    A level is dealt to as many tasks as the rows of the one below call for.
    """
    out, counts = [nodes], []
    while True:
        count, most = out[-1].agg(F.count("*"), F.max("n")).first()
        counts.append(count)
        if not count or most == 1:
            return out, counts
        runs = out[-1].where("n > 1").groupBy("tree", "n", F.expr(f"ix div {FANOUT}").alias("ix")).agg(F.sort_array(F.collect_list(F.struct("ix", "hash"))).alias("run")).coalesce(_tasks(count))
        out.append(keep(runs.select("tree", "ix", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.sha2(F.array_join("run.hash", ""), 256).alias("hash"))))


def _roots(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.where("n = 1").select("tree", "hash") for x in levels))


def _power(level) -> Column:
    """FANOUT to a level, as a double: exact for the places of any table."""
    return F.pow(F.lit(float(FANOUT)), level)


def _at(value: Column, level) -> Column:
    """value div FANOUT**level."""
    return F.floor(value / _power(level))


def _depth(n: Column) -> Column:
    """How many levels of a tree of n leaves have more than one node; a table of FANOUT**20 rows doesn't exist."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**i).cast("long") for i in range(21)]), lambda p: p < n))


def _paths(askers: DataFrame, key: list[str], first: int, levels: list[DataFrame], counts: list[int]) -> DataFrame:
    """(key, path): for each asker the nodes (level, ix, hash) that its proof needs, in order.

    An asker is the node `ix` of level `first` of its tree. From its place and the tree's n leaves follow
    the coordinates of its siblings on each level; they are exploded and looked up in the table of nodes.
    An asker at level 1 stands for its run of leaves, which share all coordinates from level 1 on, and asks for the
    run's leaves as well. The upper levels, whose nodes are asked for by many, are broadcast as far as their
    counted nodes stay within UPPER_NODES; what lies below is asked for by a small part of the askers.
    """
    n, ix = F.col("n"), F.col("ix")
    low = 0 if first else first

    def wanted(level: Column) -> Column:
        own = F.when(level >= first, _at(ix, F.greatest(level - first, F.lit(0))))
        group = F.when(level >= first, _at(ix, level - first + 1)).otherwise(ix)
        last = F.least(group * FANOUT + FANOUT - 1, F.ceil(n / _power(level)) - 1)
        return F.transform(F.filter(F.sequence(group * FANOUT, last), lambda x: own.isNull() | (x != own)), lambda x: F.struct(level.alias("level"), x.alias("ix")))

    steps = F.when(F.col("depth") > low, F.sequence(F.lit(low), F.col("depth") - 1)).otherwise(F.array().cast("array<int>"))
    asked = askers.select(*key, "tree", F.explode(F.flatten(F.transform(steps, wanted))).alias("at")).select(*key, "tree", "at.level", F.col("at.ix").alias("ix"))
    split = next((i for i in range(len(levels)) if sum(counts[i:]) <= UPPER_NODES), len(levels))
    table = [x.select("tree", F.lit(i).alias("level"), "ix", "hash") for i, x in enumerate(levels)]
    found = []
    if split:
        found.append(asked.where(F.col("level") < split).join(reduce(DataFrame.unionByName, table[:split]), ["tree", "level", "ix"]))
    if split < len(levels):
        found.append(asked.where(F.col("level") >= split).join(F.broadcast(reduce(DataFrame.unionByName, table[split:])), ["tree", "level", "ix"]))
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("level", "ix", "hash"))).alias("path"))


def _fold(start: Column, ix: Column, depth: Column, path: Column) -> Column:
    """The root that a node gives with the siblings on its path."""

    def up(acc: Column, level: Column) -> Column:
        own = _at(ix, level)
        here = F.filter(path, lambda x: x["level"] == level)
        left, right = F.filter(here, lambda x: x["ix"] < own), F.filter(here, lambda x: x["ix"] > own)
        return F.when(level == depth, acc).otherwise(F.sha2(F.concat(F.array_join(left["hash"], ""), acc, F.array_join(right["hash"], "")), 256))

    return F.aggregate(F.sequence(F.lit(0), depth), start, up)


def proofs(docs: DataFrame, columns: list[str], tampered: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """(doc_id, group, leaf, ix, n, subroot, root, proof, proof_sha256, folded_root, verified) for every row of `docs`.

    A leaf is the SHA-256 of `columns`. In each group leaves ascend by id; while a level has more than one
    node, every FANOUT consecutive nodes become the SHA-256 of their hashes. The groups' roots, in the order of
    the groups, make the last tree. `proof` lists the siblings (level, ix, hash) of the group's tree, then `top_proof` those
    of the last one. `tampered` gives the rows that are verified in place of the original ones; a proof
    is folded from its leaf, and `verified` says if that gives the root.

    Nulls: a null field is `-`, the null group comes first, and so does a null id. Repeated ids are ordered by
    their leaf, and repeated rows are leaves of their own with different siblings: which of the equal rows has which is not
    told apart. Texts of any length are hashed whole. No rows give no rows. Other columns are ignored, so they may have any name.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        leaf = lambda df: leaf_hash(*[F.col(c) for c in columns])
        original = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).alias("group"), *{c: F.col(c) for c in columns if c not in (id_col, group_col)}.values(), leaf(docs).alias("leaf_"))
        names = {id_col: "doc_id", group_col: "group"}
        now = leaf_hash(*[F.col(names.get(c, c)) for c in columns])
        changed = (tampered(original) if tampered else original).withColumn("shown", now)
        hashes = keep(changed.select("doc_id", "group", F.col("leaf_").alias("leaf"), "shown", F.monotonically_increasing_id().alias("row")))
        total = hashes.count()
        ranked = keep(_numbered(hashes, _tasks(total), "group", "doc_id", "leaf", "row"))
        keyed = ranked.select("doc_id", "group", "leaf", "shown", "name", F.col("group").isNull().alias("unnamed"), F.coalesce(F.col("group").cast("string"), F.lit("")).alias("named"))
        trees = cut(keyed.groupBy("unnamed", "named").agg(F.min("name").alias("start"), F.count("*").alias("n")).coalesce(_tasks(total)))
        n_trees = trees.count()
        trees = cut(_numbered(trees, _tasks(n_trees), "start").withColumnRenamed("name", "tree").withColumn("depth", _depth(F.col("n"))).coalesce(_tasks(n_trees)))
        hot = trees.where(F.col("n") >= hot_rows(total))
        placed = join_keyed(keyed, trees, ["unnamed", "named"], "inner", hot.select("unnamed", "named"))
        members = keep(placed.select("doc_id", "group", "shown", "tree", (F.col("name") - F.col("start")).alias("ix"), "n", "depth", F.col("leaf").alias("hash")))

        levels, counts = _levels(members.select("tree", "ix", "n", "hash"), keep)
        roots = _roots(levels).coalesce(_tasks(n_trees))
        tops = cut(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("ix"), F.lit(n_trees).cast("long").alias("n"), _depth(F.lit(n_trees)).alias("depth"), "hash"))
        top_levels, top_counts = _levels(tops.drop("depth"), keep)
        root = _roots(top_levels).collect()
        root = F.lit(root[0]["hash"] if root else None)

        none = F.array().cast("array<struct<level:int,ix:bigint,hash:string>>")
        top = tops.join(_paths(tops.withColumn("asker", F.col("ix")), ["asker"], 0, top_levels, top_counts), F.col("ix") == F.col("asker"), "left").select(F.col("ix").alias("tree"), F.col("hash").alias("subroot"), F.coalesce("path", none).alias("top_path"), F.col("depth").alias("top_depth"))
        run = F.expr(f"ix div {FANOUT}")
        runs = members.where(F.col("ix") % FANOUT == 0).select("tree", F.col("tree").alias("of"), run.alias("ix"), "n", "depth", run.alias("run"))
        path = keep(_paths(runs, ["of", "run"], 1, levels, counts).withColumnRenamed("of", "tree"))
        known = join_keyed(members, cut(top.coalesce(_tasks(n_trees))), "tree", "inner", hot.select("tree")).withColumn("run", run).join(path, ["tree", "run"], "left")
        proof = F.filter(F.coalesce("path", none), lambda x: (x["level"] > 0) | (x["ix"] != F.col("ix")))
        folded = known.withColumn("proof", proof)
        folded = folded.withColumn("proof_sha256", F.sha2(F.concat(F.array_join("proof.hash", ""), F.array_join("top_path.hash", "")), 256))
        folded = folded.withColumn("shown_subroot", _fold(F.col("shown"), F.col("ix"), F.col("depth"), F.col("proof")))
        folded = folded.withColumn("folded_root", _fold(F.col("shown_subroot"), F.col("tree"), F.col("top_depth"), F.col("top_path"))).withColumn("root", root)
        out = folded.select("doc_id", "group", F.col("hash").alias("leaf"), "ix", "n", "subroot", "root", "proof", F.col("top_path").alias("top_proof"), "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
        return cut(out)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def lowered_by_id(docs: DataFrame) -> DataFrame:
    """Texts whose id's CRC-32 is divisible by 3, with A-Z lower-cased."""
    return docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proofs(read(spark, sf_dir, "documents"), FIELDS, lowered_by_id)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"

QUERIES = {"op13_merkle": op13_merkle}
ORACLES = {
    "op13_merkle": f"""
        WITH RECURSIVE crc AS (
            SELECT doc_id, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
        shown AS (SELECT d.* REPLACE (CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text), {_LEAF} AS leaf
            FROM documents d LEFT JOIN crc USING (doc_id)),
        leaves AS MATERIALIZED (SELECT doc_id, leaf, {_LEAF.replace('text', 'shown.text')} AS shown_leaf, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS n FROM shown),
        node AS (
            SELECT tree, 0 AS level, ix, n, leaf AS h FROM leaves
            UNION ALL
            SELECT tree, level + 1, ix // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY ix)) FROM node WHERE n > 1 GROUP BY tree, level, ix // 8, n),
        sub AS (SELECT tree AS ix, h FROM node WHERE n = 1),
        top AS (
            SELECT 0 AS level, ix, (SELECT count(*) FROM sub) AS n, h FROM sub
            UNION ALL
            SELECT level + 1, ix // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY ix)) FROM top WHERE n > 1 GROUP BY level, ix // 8, n),
        run AS MATERIALIZED (SELECT tree, level, ix // 8 AS run, list(h ORDER BY ix) AS hs FROM node WHERE n > 1 GROUP BY ALL),
        top_run AS MATERIALIZED (SELECT level, ix // 8 AS run, list(h ORDER BY ix) AS hs FROM top WHERE n > 1 GROUP BY ALL),
        walk AS (
            SELECT doc_id, leaf, tree, 0 AS level, ix, n, shown_leaf AS h, '' AS proof, shown_leaf AS given, ix AS place FROM leaves
            UNION ALL
            SELECT doc_id, leaf, tree, level + 1, ix // 8, (n + 7) // 8, sha256(array_to_string(hs[:ix % 8], '') || h || array_to_string(hs[ix % 8 + 2:], '')),
                proof || array_to_string(hs[:ix % 8], '') || array_to_string(hs[ix % 8 + 2:], ''), given, place
            FROM walk JOIN run USING (tree, level) WHERE run.run = ix // 8),
        top_walk AS (
            SELECT doc_id, leaf, tree, 0 AS level, tree AS ix, (SELECT count(*) FROM sub) AS n, h, proof, given, place FROM walk WHERE n = 1
            UNION ALL
            SELECT doc_id, leaf, tree, level + 1, ix // 8, (n + 7) // 8, sha256(array_to_string(hs[:ix % 8], '') || h || array_to_string(hs[ix % 8 + 2:], '')),
                proof || array_to_string(hs[:ix % 8], '') || array_to_string(hs[ix % 8 + 2:], ''), given, place
            FROM top_walk JOIN top_run USING (level) WHERE top_run.run = ix // 8)
        SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, t.h AS folded_root, t.h = root.h AS verified
        FROM top_walk t JOIN sub ON sub.ix = t.tree JOIN (SELECT h FROM top WHERE n = 1) root ON true WHERE t.n = 1"""
}
