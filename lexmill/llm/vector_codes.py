"""Compact codes of vectors: integer parts, one codebook for each part position, Lloyd's rounds with Hamerly's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import cut, join_keyed, read, remove_folder, shared_folder
from ._hamerly import LARGEST, Rounds

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def _flat(column: pa.Array, kind) -> np.ndarray:
    """The bytes of a binary column as one array; all values have the same length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _binary(values: np.ndarray) -> pa.Array:
    """A binary column of the rows of an array."""
    rows = np.ascontiguousarray(values).reshape(len(values), -1)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows.tobytes())])


def _quantise(scale: int, parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            if len(sizes) and (sizes % parts).any():
                raise ValueError(f"vectors of {sizes[sizes % parts > 0][0]} components can't be cut into {parts} equal parts")
            whole = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(whole) and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"components of {LARGEST / scale:g} or more are too large for exact distances")
            ints, ends = whole.astype(np.int32), np.r_[0, np.cumsum(sizes)] * 4
            blob = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ints.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), blob], names=["row", "parts"])

    return run


def _assign(books: np.ndarray, moved: np.ndarray | None, width: int, last: bool):
    """One round over the rows of a table; without `moved` all are scanned, at the `last` exact errors are given instead of bounds."""
    n_parts = len(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = [Rounds(b, np.zeros(len(b)) if moved is None else moved[p]) for p, b in enumerate(books)]
        for batch in it:
            n = batch.num_rows
            x = _flat(batch.column("parts"), np.int32).reshape(n, n_parts, width).astype(np.int64)
            if moved is not None:
                was, upper, lower = (_flat(batch.column(c), t).reshape(n, n_parts) for c, t in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32)))
            code, up, low, scanned = np.empty((n, n_parts), np.uint8), np.empty((n, n_parts), np.float32), np.empty((n, n_parts), np.float32), 0
            for p, r in enumerate(rounds):
                if moved is None:
                    code[:, p], up[:, p], low[:, p] = r.first(x[:, p])
                    scanned += n
                else:
                    code[:, p], up[:, p], low[:, p], k = r.next(x[:, p], was[:, p], upper[:, p], lower[:, p])
                    scanned += k
            if last:
                error = sum(((x[:, p] - b[code[:, p]]) ** 2).sum(axis=1) for p, b in enumerate(books))
                digits = np.char.mod("%02x", code) if n else np.empty((0, n_parts), "U2")
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(["".join(d) for d in digits.tolist()], pa.string()), pa.array(np.asarray(error, np.int64))], names=["row", "code", "error"])
                continue
            before = np.full_like(code, 255) if moved is None else was
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("parts"), _binary(code), _binary(before), _binary(up), _binary(low), pa.array((code != before).any(axis=1)), pa.array(np.r_[scanned, np.zeros(n, np.int64)][:n])],
                names=["row", "parts", "code", "was", "upper", "lower", "moved", "scanned"],
            )

    return run


def _sums(n_parts: int, width: int):
    """(part, entry, component, value): what rows that changed their entry add to the new one and take from the old one; component -1 counts them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in it:
            x = _flat(batch.column("parts"), np.int32).reshape(batch.num_rows, n_parts, width).astype(np.int64)
            x = np.concatenate([np.ones((*x.shape[:2], 1), np.int64), x], axis=2)
            code, was = (_flat(batch.column(c), np.uint8).reshape(-1, n_parts) for c in ("code", "was"))
            changed = code != was
            for p in range(n_parts):
                for codes, sign in ((code, 1), (was, -1)):
                    for e in np.unique(codes[changed[:, p], p]).tolist():
                        if e < 255:
                            rows = changed[:, p] & (codes[:, p] == e)
                            total[p, e] = total.get((p, e), 0) + sign * x[rows, p].sum(axis=0)
        rows = [(p, e, c - 1, int(v)) for (p, e), sums in total.items() for c, v in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "entry", "component", "value"])

    return run


_STATE = "row long, parts binary, code binary, was binary, upper binary, lower binary, moved boolean, scanned long"


def train(ints: DataFrame, first: np.ndarray, rounds: int) -> tuple[np.ndarray, DataFrame, str, list[int]]:
    """The codebooks after `rounds`, what they have moved since, the table of states, its folder, and the parts scanned in each round.

    A round reads the state of all parts - entry and two bounds - with the vectors, and writes it anew to the shared
    folder; the table before it goes. Sums are kept from round to round: only rows that changed an entry are read for
    them. A task gives at most one row for each component of the codebooks, whose size the arguments fix.
    """
    spark, (n_parts, k, width) = ints.sparkSession, first.shape
    books, moved, path, scanned = first, None, None, []
    sums = np.zeros((n_parts, k, width + 1), np.int64)
    table = ints
    for _ in range(rounds):
        now = shared_folder(spark, "codes")
        table.mapInArrow(_assign(books, moved, width, False), _STATE).write.parquet(now)
        if path:
            remove_folder(spark, path)
        path, table = now, spark.read.parquet(now)
        scanned.append(table.agg(F.sum("scanned")).first()[0] or 0)
        change = table.where("moved").select("parts", "code", "was").mapInArrow(_sums(n_parts, width), "part int, entry int, component int, value long")
        for part, entry, component, value in change.groupBy("part", "entry", "component").agg(F.sum("value")).collect():
            sums[part, entry, component + 1] += value
        n = sums[:, :, :1]
        new = np.where(n > 0, np.floor_divide(sums[:, :, 1:], np.maximum(n, 1)), books)
        moved, books = ((new - books) ** 2).sum(axis=2), new
    return books, moved, table, path, scanned


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, in decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that has only finite components.

    Components are scaled and floored to integers; vectors are cut into `parts` equal parts, and each
    position's codebook starts as those of the `entries` smallest ids (ties: by components; a null id comes last) and
    goes through `rounds` of Lloyd's algorithm on integers: nearest entry, of several the lowest; then the floor of the
    mean; unused entries stay. The bounds of Hamerly spare most distances and change no result (see Rounds).

    Vectors that are null, or hold a null, NaN or infinity, are dropped. Repeated ids are all encoded. Fewer vectors than
    entries give smaller codebooks, none give no rows. A vector that can't be cut into equal parts, or differs in
    length from the first, and components of 65,536 or more are errors. label_error sums over equal labels, nulls together. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    kept = vectors.where(v.isNotNull() & F.forall(v, whole)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("v"))
    rows = cut(kept.withColumn("row", F.monotonically_increasing_id()))
    ints = cut(rows.select("row", "v").mapInArrow(_quantise(scale, parts), "row long, parts binary"))
    heads = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("row", F.monotonically_increasing_id().alias("at"))
    first = [r["parts"] for r in ints.join(F.broadcast(heads), "row").orderBy("at").select("parts").collect()]
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = len(first[0]) // 4 // parts
    if not ints.where(F.length("parts") != len(first[0])).isEmpty():
        raise ValueError("vectors differ in length")
    books = np.stack([np.frombuffer(b, np.int32).reshape(parts, width) for b in first], axis=1).astype(np.int64)
    books, moved, table, path, _ = train(ints, books, rounds)
    coded = cut(table.mapInArrow(_assign(books, moved if rounds else None, width, True), "row long, code string, error long"))
    if path:
        remove_folder(spark, path)
    both = cut(rows.select("row", "vec_id", "label").join(coded, "row").withColumn("unnamed", F.col("label").isNull()).withColumn("named", F.coalesce(F.col("label").cast("string"), F.lit(""))))
    errors = both.groupBy("unnamed", "named").agg(F.sum("error").alias("label_error"))
    return join_keyed(both, cut(errors), ["unnamed", "named"], "inner").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    """Every round spelled out, for vectors whose length is a multiple of the parts."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS nr, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT nr, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v FROM kept, range({PARTS}) t(p)),
        book0 AS MATERIALIZED (SELECT p, nr AS e, v AS c FROM part WHERE nr < {ENTRIES})"""
    ]
    near = """near{0} AS MATERIALIZED (SELECT nr, p, any_value(v) AS v, min(struct_pack(d := d, e := e)) AS best FROM (
            SELECT nr, part.p, v, e, coalesce(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)::BIGINT AS d FROM part JOIN book{0} b ON b.p = part.p) GROUP BY nr, p)"""
    for r in range(ROUNDS):
        steps.append(near.format(r))
        steps.append(f"""mean{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
            SELECT p, best.e AS e, i, (sum(v[i])::BIGINT - ((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m FROM near{r}, range(1, len(v) + 1) t(i) GROUP BY p, best.e, i) GROUP BY p, e)""")
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)")
    steps.append(near.format(ROUNDS))
    steps.append("done AS (SELECT nr, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near" + str(ROUNDS) + " GROUP BY nr)")
    books = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS})"
    return ", ".join(steps) + f" SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {books} AS codebooks_sha256 FROM kept JOIN done USING (nr)"


QUERIES = {"op11_codes": op11_codes}
ORACLES = {"op11_codes": _sql()}
