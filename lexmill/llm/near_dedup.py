"""Near-duplicate classes: ProbMinHash, banding, exact verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import HOT_SHARE, cut, join_keyed, read
from ._probminhash import band_hashes, signatures
from ._shingles import batches, probability_jaccard, weighted_shingles

#: Texts are hashed together up to so many characters; a longer text goes alone.
CHUNK_CHARS = 1_000_000
#: Members of one large centre that are compared with one copy of its text.
SALT_ROWS = 1024
#: Members of one centre, and characters of their texts, in a block that a task holds.
BLOCK_ROWS, BLOCK_CHARS = 2048, 8_000_000
#: Links that one task of the search for components gets.
TASK_LINKS = 100_000


def _sign(k: int, bands: int, rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, shas, texts = batch.column(0), batch.column(1), batch.column(2)
            items = ((i, texts[i].as_py()) for i in range(batch.num_rows))
            for chunk in batches(items, CHUNK_CHARS, lambda x: len(x[1])):
                at = [i for i, _ in chunk]
                sets = [weighted_shingles(t, k) for _, t in chunk]
                owner = np.repeat(np.arange(len(sets)), [len(a) for a, _ in sets])
                regs = signatures(np.concatenate([a for a, _ in sets]), np.concatenate([w for _, w in sets]), owner, len(sets), bands * rows)
                hashes = band_hashes(regs, bands)
                keys = [hashlib.blake2b(a.tobytes() + w.astype(np.int64).tobytes() if len(a) else shas[i].as_py().encode(), digest_size=16).digest() for i, (a, w) in zip(at, sets, strict=True)]
                # texts without words have no shingles: only equal texts are alike
                lists = [hashes[j].tolist() if len(s[0]) else [] for j, s in enumerate(sets)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at[0], len(at)), shas.slice(at[0], len(at)), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "sha", "key", "bands"],
                )

    return run


def _compare(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in it:
            out: list[tuple] = []
            for c, node, is_member, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                c, own = c.as_py(), weighted_shingles(text.as_py(), k)
                if not is_member.as_py():
                    centre, held = c, own
                elif c == centre:
                    lost, extra = np.zeros((2, max(64, -len(held[0]) % 64 + len(held[0]))), bool)
                    lost[: len(held[0])] = ~np.isin(held[0], own[0], assume_unique=True)
                    extra[own[0][~np.isin(own[0], held[0], assume_unique=True)] % np.uint64(len(extra))] = True
                    bits = (np.packbits(x).view(np.int64).tolist() for x in (lost, extra))
                    out.append((node.as_py(), c, probability_jaccard(held, own), *bits, int(own[1].sum())))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["node", "centre", "similarity", "lost", "extra", "weight"])

    return run


def _own(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                keys, w = weighted_shingles(text.as_py(), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), node.as_py())), pa.array(keys.view(np.int64)), pa.array(w / w.sum())], names=["node", "shingle", "share"])

    return run


def own_share(texts: DataFrame, k: int) -> DataFrame:
    """(node, own): the share of each node's weight in shingles that no other node of `texts` has."""
    rows = texts.select("node", "text").mapInArrow(_own(k), "node long, shingle long, share double")
    lone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("share").alias("share")).where("n = 1")
    return lone.groupBy("node").agg(F.sum("share").alias("own"))


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, centre, similarity, lost, extra, weight) of `pairs` (node, centre): their exact similarity, a
    bit for each distinct shingle of the centre that the node lacks, as many bits in which those that only
    the node has are marked by a hash, and the node's total weight.

    Members stream past their centre's shingles, so a task holds two texts at a time. A centre's members
    are dealt by a hash of the node, each share with its own copy of the centre's text; the number of
    shares grows with all pairs, so a centre with a large part of them has shares of SALT_ROWS members.
    """
    pairs = cut(pairs)
    salts = pairs.count() // SALT_ROWS + 1
    members = pairs.select("centre", F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt"), "node", F.lit(True).alias("is_member"))
    heads = members.select("centre", "salt").distinct().select("centre", "salt", F.col("centre").alias("node"), F.lit(False).alias("is_member"))
    rows = members.unionByName(heads).join(texts, "node").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "is_member", "node")
    return rows.select("centre", "node", "is_member", "text").mapInArrow(_compare(k), "node long, centre long, similarity double, lost array<long>, extra array<long>, weight long")


class _Block:
    """Members of one centre, and the classes that links have joined so far."""

    def __init__(self, k: int, threshold: float):
        self.k, self.least = k, threshold - 1e-9
        self.n, self.parent, self.texts, self.sets = 0, {}, [], {}
        self.root, self.weight = np.empty(64, np.int64), np.empty(64)
        self.lost = self.extra = np.empty((64, 0), np.uint64)

    def find(self, comp: int) -> int:
        while comp in self.parent:
            comp = self.parent[comp]
        return comp

    def add(self, comp: int, lost: np.ndarray, extra: np.ndarray, weight: int, text: str) -> None:
        if self.n == 0:
            self.lost, self.extra = (np.empty((len(self.root), len(lost)), np.uint64) for _ in range(2))
        if self.n == len(self.root):
            self.root, self.weight, self.lost, self.extra = (np.concatenate([x, np.empty_like(x)]) for x in (self.root, self.weight, self.lost, self.extra))
        self.root[self.n], self.lost[self.n], self.extra[self.n], self.weight[self.n] = self.find(comp), lost, extra, weight
        self.texts.append(text)
        self.n += 1

    def links(self, comp: int, lost: np.ndarray, extra: np.ndarray, weight: int, text: str) -> Iterator[tuple[int, int]]:
        """Links from a text to members of other classes: as many as join classes."""
        mine = self.find(comp)
        far = np.flatnonzero(self.root[: self.n] != mine)
        if not len(far):
            return
        # of either one's weight, at least this much is not in the other: what of the centre only it holds, and
        # the marks that only it has; then the similarity is at most (1 - a)(1 - b) / (1 - ab)
        theirs, more = self.lost[far], self.extra[far]
        count = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        a = (count(lost & ~theirs) + count(more & ~extra)) / self.weight[far]
        b = (count(theirs & ~lost) + count(extra & ~more)) / weight
        most = (1 - a) * (1 - b) / np.maximum(1 - a * b, 1e-12)
        fits = most >= self.least - 1e-9
        own = None
        for i in far[fits][np.argsort(-most[fits], kind="stable")].tolist():
            if self.root[i] == mine:
                continue
            own = own or weighted_shingles(text, self.k)
            if i not in self.sets:
                self.sets[i] = weighted_shingles(self.texts[i], self.k)
            if probability_jaccard(self.sets[i], own) >= self.least:
                other = int(self.root[i])
                yield mine, other
                self.parent[other] = mine
                self.root[: self.n][self.root[: self.n] == other] = mine


def _join_classes(k: int, threshold: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in it:
            out: list[tuple[int, int]] = []
            for centre, number, part, streams, comp, lost, extra, weight, text in zip(*batch.columns, strict=True):
                here = (centre.as_py(), number.as_py(), part.as_py())
                if here != at:
                    at, block = here, _Block(k, threshold)
                bits = (x.values.to_numpy().view(np.uint64) for x in (lost, extra))
                row = (comp.as_py(), *bits, weight.as_py(), text.as_py())
                if streams.as_py():
                    out += block.links(*row)
                else:
                    block.add(*row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["node", "centre"])

    return run


def meetings(tested: DataFrame, comps: DataFrame, chars: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(centre, block, part, streams, node, comp, lost, extra, weight): which members of a centre meet where, if several classes have any.

    Members are dealt to blocks of block_rows rows or block_chars characters, each to one that holds it. Those of the centre's largest
    class are joined already and only wait there; all others also stream past each block, in parts of the same size, each with a
    copy of the block. So of n members, m of them outside that class, there are up to n + 2 * m * n / block_rows rows:
    in proportion to the members as long as nearly all are alike.
    """
    named = tested.join(comps, "node", "left").select("node", "centre", F.coalesce("comp", "node").alias("comp"), "lost", "extra", "weight")
    members = cut(named.join(chars, "node"))
    sizes = cut(members.groupBy("centre", "comp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")))
    sums = sizes.groupBy("centre").agg(F.count("*").alias("classes"), F.max(F.struct("n", "comp", "chars")).alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).where("classes > 1")
    size = lambda n, chars: F.ceil(F.greatest(n / block_rows, chars / block_chars)).cast("int")
    several = sums.select("centre", F.col("main.comp").alias("main"), size(F.col("n"), F.col("chars")).alias("blocks"), size(F.col("n") - F.col("main.n"), F.col("chars") - F.col("main.chars")).alias("parts"))
    dealt = join_keyed(members.drop("chars"), cut(several), "centre", "inner")
    homes = F.expr("transform(sequence(0, parts - 1), p -> struct(cast(pmod(xxhash64(node), blocks) as int) as block, p as part, false as streams))")
    visits = F.expr("if(comp = main, array(), transform(sequence(0, blocks - 1), x -> struct(x as block, cast(pmod(xxhash64(node, 1), parts) as int) as part, true as streams)))")
    met = dealt.select("node", "centre", "comp", "lost", "extra", "weight", F.explode(F.concat(homes, visits)).alias("m"))
    return met.select("centre", "m.block", "m.part", "m.streams", "node", "comp", "lost", "extra", "weight")


def bridges(tested: DataFrame, comps: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node, centre): links between the classes `comps` of members of one centre, named by class.

    A task holds a block of a centre's members and streams those past it that aren't of the largest class (see meetings()). Only members of
    different classes whose bits allow a link are compared as texts, and a link joins their classes for
    the rest of the task, so it gives fewer rows than it has members.
    """
    rows = meetings(tested, comps, texts.select("node", F.length("text").alias("chars"))).join(texts, "node")
    rows = rows.repartition("centre", "block", "part").sortWithinPartitions("centre", "block", "part", "streams", "node")
    return rows.select("centre", "block", "part", "streams", "comp", "lost", "extra", "weight", "text").mapInArrow(_join_classes(k, threshold), "node long, centre long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link: comp is the smallest node that can be reached.

    Minimum labels spread along the links, and every round also takes the label of the label, so long
    chains need a logarithmic number of rounds. Links are far fewer than documents: each step has as many
    tasks as the number of links calls for.
    """
    edges = cut(links.select(F.col("node").alias("a"), F.col("centre").alias("b")).unionByName(links.select(F.col("centre").alias("a"), F.col("node").alias("b"))).distinct())
    n = edges.count()
    tasks = n // TASK_LINKS + 1
    edges = cut(edges.coalesce(tasks))
    # hubs with a large part of the links - 256 at most - get their label by broadcast
    hubs = cut(edges.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") >= max(1000, n * HOT_SHARE)).select("b").coalesce(1))
    far, near_hub = edges.join(F.broadcast(hubs), "b", "left_anti"), edges.join(F.broadcast(hubs), "b", "left_semi")
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("b")).coalesce(tasks).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")))
    while True:
        label = labels.withColumnRenamed("node", "b")
        told = far.join(label, "b").coalesce(tasks).unionByName(near_hub.join(F.broadcast(label.join(F.broadcast(hubs), "b", "left_semi")), "b"))
        near = told.groupBy("a").agg(F.min("comp").alias("near")).coalesce(tasks)
        step = cut(labels.join(near, labels.node == near.a).coalesce(tasks).select("node", "comp", F.least("comp", "near").alias("new")))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        # the old label comes along, so that a change can be seen without another join
        moved = cut(join_keyed(step, jump, "new").coalesce(tasks).select("node", F.col("comp").alias("old"), F.least("new", F.coalesce("far", "new")).alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 6) -> DataFrame:
    """(doc_id, sha, class_id, class_size, kept, keep_sha) for every row of `docs`.

    Documents are linked when the probability Jaccard similarity of their k-word shingles, weighted by
    how often they occur, is `threshold` or more; a class is a set of documents connected by links.
    Candidates share one of `bands` bands of `rows` ProbMinHash registers (with the defaults a pair at
    0.8 is missed with probability 5e-6). Copies with the same shingles are one node of the graph.

    Verification gives the same links as comparing all pairs in a bucket, without listing them. Shingles
    that no other candidate has bound a node's similarity to anything, which drops most false candidates.
    Each bucket then has a centre, the node with the least of its own, and all others are compared with
    it. Only members of one centre that are in different classes after that are left: bridges() joins
    those that are alike, block by block, where what either lacks of the centre or has besides it bounds
    their similarity.

    class_id is the smallest doc_id of the class, and one document with it is kept: of several texts the one
    with the smallest SHA-256 (keep_sha), of repeated rows one. `sha` tells apart texts that share a doc_id. Null and empty texts, and
    texts without words, are alike only when equal (null counts as empty). Texts of fewer than k words
    are one shingle. Repeated rows are both returned, in one class. A null doc_id is allowed: such a
    row takes part, and can be kept only if no document of its class has an id. Other columns are ignored, so
    they may have any name.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = cut(base.mapInArrow(_sign(k, bands, rows), "doc_id long, sha string, key binary, bands array<long>").withColumn("row", F.monotonically_increasing_id()))
    first = signed.groupBy("key").agg(F.min(F.struct("doc_id", "sha")).alias("at"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha", "row")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = cut(first.sortWithinPartitions("key").select(F.monotonically_increasing_id().alias("node"), "key", F.col("at.doc_id").alias("doc_id"), F.col("at.sha").alias("sha"), "least", "copies", "bands"))

    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    found = cut(exploded.join(shared, "bucket"))
    wanted = found.select("node").distinct().join(nodes.select("node", "doc_id", "sha"), "node")
    texts = cut(base.join(wanted, base.doc_id.eqNullSafe(wanted.doc_id) & (base.sha == wanted.sha)).select("node", "text").dropDuplicates(["node"]))
    # a node with more than 1 - threshold on its own has no link at all
    own = own_share(texts, k)
    buckets = cut(found.join(own, "node", "left").select("bucket", "node", F.coalesce("own", F.lit(0.0)).alias("own")).where(F.col("own") <= 1 - threshold + 1e-9))
    centres = buckets.groupBy("bucket").agg(F.min(F.struct("own", "node")).alias("c"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("c.node").alias("centre"))
    placed = join_keyed(buckets, cut(centres), "bucket", "inner")
    tested = cut(compared(placed.select("node", "centre").where("node <> centre").distinct(), texts, k))
    # similarities are sums in floating point: one of exactly the threshold can come out a little lower
    least = threshold - 1e-9
    links = tested.where(F.col("similarity") >= least).select("node", "centre")
    comps = components(links)
    # what is still in different classes of one centre
    more = cut(bridges(tested, comps, texts, k, threshold).distinct())
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
        both = comps.unionByName(joined.select(F.col("comp").alias("node"), "comp").join(comps.select("node"), "node", "left_anti"))
        comps = cut(both.join(joined, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp")))
    named = cut(nodes.select("node", "key", "least", "copies").join(comps, "node", "left").select("key", "least", "copies", F.coalesce("comp", "node").alias("comp")))
    sizes = named.groupBy("comp").agg(F.min("least").alias("keep"), F.sum("copies").alias("class_size"))
    by_key = join_keyed(named, cut(sizes), "comp", "inner").select("key", F.col("keep.doc_id").alias("class_id"), "class_size", F.col("keep.row").alias("keep_row"), F.col("keep.sha").alias("keep_sha"))
    return join_keyed(signed.select("doc_id", "sha", "row", "key"), by_key, "key", "inner").select("doc_id", "sha", "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept"), "keep_sha")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("sha", "keep_sha")


QUERIES = {"op1_minhash": op1_minhash}
ORACLES: dict[str, str] = {}
