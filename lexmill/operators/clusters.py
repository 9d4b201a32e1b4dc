"""Density clusters without listing pairs, their descriptions, and matching rows to a kept table of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .graph import components, reliable
from .numbering import numbered

#: Vectors of a cell that a task holds; clusters that one pass over the rows compares with.
BLOCK_ROWS, BLOCK_CLUSTERS = 4096, 4096
CHUNK = 512

# How far noise may be from a cluster, cut-offs and words of labels.
NOISE_DISTANCE, TOP_GRAMS, LABEL_GRAMS = 0.35, 5, 2
DIGIT_LEVEL, FRONT, BACK = 0.01, 0.3, 0.7
DIGITS, TEXT, NO_GRAMS, ZONES = "数字密集", "文本为主", "未分类", ("前段", "中段", "后段")
HYBRID = ((0, 6, 0.30), (6, 10, 0.20), (0, None, 0.50))


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((v / np.linalg.norm(v, axis=1, keepdims=True)) @ pivots.T, -1, 1))


class _Classes:
    """Classes of names that links have joined; the smallest name stands for a class."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class Cells:
    """Vectors dealt to the nearest of some pivots, and the blocks of cells that each can have neighbours in.

    Angles obey the triangle inequality, so a neighbour can only be in a cell whose pivot is no farther than the cell's
    radius and the greatest angle allowed: a vector visits the blocks of these cells as a guest, and no pair is
    lost. A cell's members live in blocks of BLOCK_ROWS or so. How many blocks a guest visits depends on how the
    vectors cluster. The pivots are a bounded sample. Vectors without length have no neighbours.
    """

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, eps: float, pivots: int = 64, block_rows: int = BLOCK_ROWS):
        if not eps < 1:
            raise ValueError("eps has to be less than 1")
        ship(vectors.sparkSession)
        v = F.transform(vector_col, lambda x: x.cast("double"))
        square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
        self.eps, self.rows = eps, vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(square > 0)
        sample = self.rows.orderBy(F.xxhash64("id")).limit(pivots).collect()  # bounded
        axes = np.array([r["v"] for r in sample] or [[1.0]])
        self.axes = axes = axes / np.linalg.norm(axes, axis=1, keepdims=True)

        @F.pandas_udf("struct<cell:int,angle:double>")
        def nearest(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in it:
                a = _angles(np.stack(part.to_numpy()), axes) if len(part) else np.zeros((0, 1))
                yield pd.DataFrame({"cell": a.argmin(axis=1).astype(np.int32), "angle": a.min(axis=1)} if len(part) else {"cell": [], "angle": []})

        placed = self.rows.withColumn("c", nearest("v")).select("id", "v", "c.cell", "c.angle")
        radii, blocks = np.full(len(axes), -np.inf), np.ones(len(axes), int)
        for r in placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # one row for each pivot
            radii[r["cell"]], blocks[r["cell"]] = r["r"], -(-r["n"] // block_rows)
        reach = float(np.arccos(1 - eps)) + 1e-9

        @F.pandas_udf("array<struct<cell:int,block:int>>")
        def blocks_near(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in it:
                fits = _angles(np.stack(part.to_numpy()), axes) <= radii + reach if len(part) else []
                yield pd.Series([[{"cell": int(c), "block": b} for c in np.flatnonzero(f) for b in range(blocks[c])] for f in fits], dtype=object)

        self.near = blocks_near
        self.blocks = F.get(F.array(*(F.lit(int(x)) for x in blocks)), F.col("cell"))
        block = F.pmod(F.xxhash64("id"), self.blocks).cast("int")
        self.homes = placed.select("cell", block.alias("block"), "id", "v")

    def neighbours(self, homes: DataFrame) -> DataFrame:
        """Homes as guests of the next block alone, that of their cell or else the first of the next cell."""
        more = F.col("block") + 1 < self.blocks
        at = F.struct(F.when(more, F.col("cell")).otherwise(F.col("cell") + 1).alias("cell"), F.when(more, F.col("block") + 1).otherwise(0).alias("block"))
        return homes.withColumn("b", at).drop("cell", "block")

    def meet(self, homes: DataFrame, guests: DataFrame, task, schema: str) -> DataFrame:
        """task(held, guest batches) for each block: `homes` (cell, block, id, v, ...) are held, `guests` (id, v, ...) stream past.

        Both have the same further columns; a task gets a block's homes as one DataFrame, and yields rows for each chunk of guests.
        Guests visit all blocks where they can have neighbours, or the one that they name in `b`.
        """
        names = [c for c in guests.columns if c != "b"]
        placed = guests if "b" in guests.columns else guests.withColumn("b", F.explode(self.near("v")))
        visits = placed.select("b.cell", "b.block", F.lit(True).alias("guest"), *names)
        rows = homes.select("cell", "block", F.lit(False).alias("guest"), *names).unionByName(visits)
        rows = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "guest")

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, held, state = None, [], None
            for part in it:
                for key, some in part.groupby(["cell", "block"], sort=False):
                    if key != at:
                        at, held, state = key, [], None
                    own, visiting = some[~some["guest"]], some[some["guest"]]
                    if len(own):
                        held.append(own)
                    if len(visiting) and held:
                        if state is None:
                            state = task(pd.concat(held))
                        for lo in range(0, len(visiting), CHUNK):
                            yield state(visiting.iloc[lo : lo + CHUNK])

        return rows.mapInPandas(run, schema)


def _unit(some: pd.DataFrame) -> np.ndarray:
    v = np.stack(some["v"].to_numpy())
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    return np.maximum(1 - a @ b.T, 0) <= eps


def _inner_classes(v: np.ndarray, eps: float) -> np.ndarray:
    """Of each vector, the first one that it is joined to by neighbours."""
    root = np.arange(len(v))
    for lo in range(0, len(v), CHUNK):
        for i, row in enumerate(_near(v[lo : lo + CHUNK], v, eps)):
            row[lo + i] = True
            met = np.unique(root[row])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return root


def dbscan(vectors: DataFrame, id_col: str, vector_col: str, eps: float = 0.35, least: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, cluster): density clusters by cosine distance; -1 is noise.

    A core point has at least `least` other points within eps; cores that are neighbours share a cluster,
    and a border point joins the smallest cluster of its cores. If all points are noise they are one cluster.

    No pairs are listed. Blocks first give the number of neighbours that they hold of each guest. Then the cores of a block are
    joined inside it, and each core is named by its class. Guests that are cores bring that class along,
    and a block gives a link only if it joins two classes that it has not seen joined: fewer links than classes. First, blocks
    only meet the next one, which leaves few classes of a dense cluster; then all meet. Border points
    ask for the classes of the cores near them.
    """
    ids = vectors.select(F.col(id_col).alias("id"))
    cells = Cells(vectors, id_col, vector_col, eps, block_rows=block_rows)
    kind = cells.rows.schema["id"].dataType.simpleString()
    homes = reliable(cells.homes)

    def count(held: pd.DataFrame):
        v, own = _unit(held), held["id"].to_numpy()

        def each(guests: pd.DataFrame) -> pd.DataFrame:
            names = guests["id"].to_numpy()
            return pd.DataFrame({"id": names, "n": (_near(_unit(guests), v, eps) & (names[:, None] != own)).sum(axis=1)})

        return each

    def join_classes(held: pd.DataFrame):
        v, classes, joined = _unit(held), held["class"].to_numpy(), _Classes()

        def each(guests: pd.DataFrame) -> pd.DataFrame:
            near, own, links = _near(_unit(guests), v, eps), guests["class"].to_numpy(), []
            for c in np.unique(own):
                links += [(c, other) for other in np.unique(classes[near[own == c].any(axis=0)]) if joined.join(c, other)]
            return pd.DataFrame(links, columns=["src", "dst"])

        return each

    def ask_classes(held: pd.DataFrame):
        v, classes = _unit(held), held["class"].to_numpy()

        def each(guests: pd.DataFrame) -> pd.DataFrame:
            found = [(i, c) for i, row in zip(guests["id"], _near(_unit(guests), v, eps), strict=True) for c in np.unique(classes[row])]
            return pd.DataFrame(found, columns=["id", "class"])

        return each

    def inside(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        names = block["id"].to_numpy()
        return pd.DataFrame({"id": names, "class": names[_inner_classes(_unit(block), eps)]})

    counts = cells.meet(homes, homes.select("id", "v"), count, f"id {kind}, n long")
    cores = counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("id", F.lit(True).alias("core"))
    marked = reliable(homes.join(cores, "id", "left"))
    named = reliable(marked.where("core").groupBy("cell", "block").applyInPandas(inside, f"id {kind}, class {kind}"))
    held = reliable(marked.where("core").join(named, "id").select("cell", "block", "id", "v", "class"))
    pairs = f"src {kind}, dst {kind}"
    near = components(named.select("class").distinct(), reliable(cells.meet(held, cells.neighbours(held), join_classes, pairs)), "class")
    named = reliable(named.join(near, "class").select("id", F.col("component").alias("class")))
    held = reliable(held.join(near, "class").select("cell", "block", "id", "v", F.col("component").alias("class")))
    links = reliable(cells.meet(held, held.select("id", "v", "class"), join_classes, pairs))
    labels = components(named.select("class").distinct(), links, "class")
    edge = marked.where("core is null").select("id", "v", F.lit(None).cast(kind).alias("class"))
    border = cells.meet(held, edge, ask_classes, f"id {kind}, class {kind}").distinct()
    found = named.unionByName(border).join(labels, "class").groupBy("id").agg(F.min("component").alias("c"))
    out = ids.join(found, "id", "left")
    if named.isEmpty():
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("cluster"))
    return out.select(F.col("id").alias(id_col), F.coalesce("c", F.lit(-1)).cast("long").alias("cluster"))


# ---- descriptions of clusters, and rows matched to them ----


def describe(points: DataFrame, vector_col: str = "vector", cluster_col: str = "cluster", grams_col: str = "grams") -> DataFrame:
    """(cluster, cluster_id, members, centroid, top_grams, label) of the clusters of points; noise (-1 or null) has none.

    `points` has a cluster, a vector of doubles and an array of the n-grams of its text. Clusters are numbered by size, of
    equal ones the smaller first. The label tells if its members have many digits (the seventh number of the centroid), the most
    frequent n-grams (ties by name) and where in their documents they stand (the first number).
    """
    inner = points.where(F.col(cluster_col) != -1).select(F.col(cluster_col).alias("cluster"), F.col(vector_col).alias("v"), F.col(grams_col).alias("g"))
    means = inner.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    centroids = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    counts = inner.select("cluster", F.explode("g").alias("gram")).groupBy("cluster", "gram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "gram"))  # Spark keeps the first few of a task before it shuffles
    top = counts.withColumn("place", place).where(F.col("place") <= TOP_GRAMS)
    best = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("top_grams"))
    sized = inner.groupBy("cluster").agg(F.count("*").alias("members"))
    rows = reliable(sized.join(centroids, "cluster").join(best, "cluster", "left").withColumn("top_grams", F.coalesce("top_grams", F.array().cast("array<string>"))))
    at = numbered(rows, -F.col("members"), F.col("cluster"))
    first, seventh = F.get("centroid", F.lit(0)), F.coalesce(F.get("centroid", F.lit(6)), F.lit(0.0))
    zone = F.when(first < FRONT, ZONES[0]).when(first <= BACK, ZONES[1]).otherwise(ZONES[2])
    grams = F.array_join(F.slice("top_grams", 1, LABEL_GRAMS), "")
    label = F.concat_ws("-", F.when(seventh > DIGIT_LEVEL, DIGITS).otherwise(TEXT), F.when(grams == "", NO_GRAMS).otherwise(grams), zone)
    return at.select("cluster", F.format_string("C_%03d", "ix").alias("cluster_id"), "members", "centroid", "top_grams", label.alias("label"))


def _hybrid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of classify.hybrid_distance between vectors and centroids, which have no n-grams of their own."""

    def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        norm = na[:, None] * nb
        return np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm > 0)

    return np.maximum(0, 1 - sum(w * cosine(x[:, lo:hi], centroids[:, lo:hi]) for lo, hi, w in HYBRID))


def match(points: DataFrame, table: DataFrame, id_col: str, vector_col: str = "vector", within: float | None = None) -> DataFrame:
    """(id, cluster, distance): the nearest cluster of a described table for each point, null if there is none nearer than `within`.

    All points are compared with all clusters, which is the question, in blocks of BLOCK_CLUSTERS centroids; of equally
    near ones the smaller cluster counts. With no clusters there is no match.
    """
    ship(points.sparkSession)
    base = points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    known, kind = numbered(table.select("cluster", "centroid"), F.col("cluster")), table.schema["cluster"].dataType.simpleString()
    best = None
    for block in range(-(-known.count() // BLOCK_CLUSTERS)):
        rows = known.where((F.col("ix") >= block * BLOCK_CLUSTERS) & (F.col("ix") < (block + 1) * BLOCK_CLUSTERS)).orderBy("ix").collect()  # a bounded block
        names, centroids = np.array([r["cluster"] for r in rows]), np.array([r["centroid"] for r in rows])

        def nearest(it: Iterator[pd.DataFrame], names=names, centroids=centroids) -> Iterator[pd.DataFrame]:
            for part in it:
                if len(part):
                    d = np.concatenate([_hybrid(np.stack(part["v"].iloc[lo : lo + CHUNK].to_numpy()), centroids) for lo in range(0, len(part), CHUNK)])
                    yield pd.DataFrame({"id": part["id"], "distance": d.min(axis=1), "cluster": names[d.argmin(axis=1)]})

        found = base.mapInPandas(nearest, f"id {base.schema['id'].dataType.simpleString()}, distance double, cluster {kind}")
        best = found if best is None else best.unionByName(found)
    if best is None:
        return base.select(F.col("id").alias(id_col), F.lit(None).cast(kind).alias("cluster"), F.lit(None).cast("double").alias("distance"))
    if known.count() > BLOCK_CLUSTERS:
        best = best.groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("m")).select("id", "m.*")
    near = F.lit(True) if within is None else F.col("distance") < within
    return best.select(F.col("id").alias(id_col), F.when(near, F.col("cluster")).alias("cluster"), F.when(near, F.col("distance")).alias("distance"))


def absorb_noise(points: DataFrame, id_col: str, vector_col: str = "vector", cluster_col: str = "cluster", within: float = NOISE_DISTANCE) -> DataFrame:
    """The points (id, vector, cluster, ...) with noise (-1) given to the nearest cluster's mean, if that is nearer than `within`."""
    inner = points.where(F.col(cluster_col) != -1)
    means = inner.select(F.col(cluster_col).alias("cluster"), F.posexplode(vector_col).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    table = reliable(means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid")))
    found = match(points.where(F.col(cluster_col) == -1), table, id_col, vector_col, within).select(F.col(id_col), F.col("cluster").alias("_found"))
    return points.join(found, id_col, "left").withColumn(cluster_col, F.coalesce("_found", cluster_col)).drop("_found")
