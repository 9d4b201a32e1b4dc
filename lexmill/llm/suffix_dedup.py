"""Removal of passages that repeat across documents: suffix arrays of shards, merged by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import cut, read, remove_folder, shared_folder
from ._suffix import anchors, mixed, window_groups, words

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Anchors, and bytes of windows' texts, that one task of a merge gets.
RANGE_ANCHORS, RANGE_BYTES = 1 << 20, 1 << 21
#: An anchor that occurs so often has its windows dealt one by one.
HOT_ANCHORS = 2000
#: Windows that are sorted as one run in a merge.
RUN_WINDOWS = 250_000
#: So many bits more than number all anchors are told of each, so that few are taken for another one.
SPARE_BITS = 12
_LAST = np.iinfo(np.int64).max
_CODEC = pa.Codec("zstd", 3)


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _expand(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _CODEC.decompress(data[8:], n, asbytes=True) if n else b""


def _pack(values: np.ndarray) -> bytes:
    """Ascending or repetitive integers as differences, byte by byte, compressed."""
    d = np.diff(np.asarray(values, np.int64), prepend=np.int64(0))
    return _squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.int64))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal neighbours start and end."""
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(values)], strict=False))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SHARD = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("text", pa.binary()), ("n_bytes", pa.int64())])


def _shards(most: int):
    """Consecutive documents of a partition, packed."""

    def packed(number: int, ids: list, texts: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, texts)])
        return _batch([(number, ids, _pack(ends), _squeeze(b"".join(texts)), int(ends[-1]))], _SHARD)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in it:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if ids and size + len(text) > most:
                    yield packed(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(id_)
                texts.append(text)
                size += len(text)
        if ids:
            yield packed(number, ids, texts)

    return run


class _Shard:
    """A shard's text, its windows - those that lie in one document - and the runs of windows with one anchor."""

    def __init__(self, ids: list, lengths: bytes, text: bytes, length: int, key_bits: int):
        self.text = np.frombuffer(_expand(text), np.uint8)
        self.ends = _unpack(lengths)
        self.ids, self.key_bits = ids, key_bits
        ranks = np.array([_LAST if i is None else i for i in ids], np.int64)
        sizes = np.diff(self.ends)
        whole = np.ones(len(self.text), bool)  # positions from which a window stays in its document
        for end, size in zip(self.ends[1:].tolist(), sizes.tolist(), strict=True):
            whole[end - min(size, length - 1) : end] = False
        self.at = np.flatnonzero(whole).astype(np.int32)
        low = anchors(self.text, length)[self.at]
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[self.at]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.ranks = ranks
        first = np.flatnonzero(new)
        low = mixed(low[first])  # the least of several hashes isn't dealt evenly
        #: of each window, its run
        self.run = np.cumsum(new, dtype=np.int32) - np.int32(1)
        #: the distinct anchors, ascending; of each run, which it has; how often one occurs
        self.keys, self.key_of, self.times = np.unique((low >> np.uint64(64 - key_bits)).astype(np.int64), return_inverse=True, return_counts=True)
        self.key_of = self.key_of.astype(np.int32)
        long = np.diff(np.r_[first, len(self.at)]) > length
        self.several = self.times > 1
        self.several[self.key_of[long]] = True

    def rank(self, window: np.ndarray) -> np.ndarray:
        return self.ranks[self.doc[window]]

    def slices(self, bits: int) -> Iterator[tuple[int, slice]]:
        """The ranges of anchors, and where they are in `keys`."""
        of = self.keys >> (self.key_bits - bits)
        for a, b in _runs(of):
            yield int(of[a]), slice(a, b)


_ANCHORS = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
_MASKS = pa.schema([("shard", pa.int64()), ("range", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())])
#: What a shard finds: windows it asks others about, by ranges; under a range below 0, what it has settled itself.
_FOUND = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary()), ("ranks", pa.binary()), ("text", pa.binary())])
_FLAGS = pa.schema([("shard", pa.int64()), ("flags", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()), ("ranks", pa.binary())])


def _list_anchors(length: int, key_bits: int, bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for shard, ids, lengths, text in zip(*(batch.column(c) for c in ("shard", "ids", "lengths", "text")), strict=True):
                s = _Shard(ids.as_py(), lengths.as_py(), text.as_py(), length, key_bits)
                yield _batch([(r, shard.as_py(), _pack(s.keys[at]), _pack(s.times[at])) for r, at in s.slices(bits)], _ANCHORS)

    return run


def _shared_anchors(hot: int):
    """For each shard, a bit for each of its anchors in this range: does another shard have it; does it occur `hot` times?"""

    def run(table: pa.Table) -> pa.Table:
        keys, times = ([_unpack(x) for x in table.column(c).to_pylist()] for c in ("keys", "times"))
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        shards = np.bincount(which, minlength=len(distinct))
        total = np.bincount(which, np.concatenate(times), minlength=len(distinct))
        out, done = [], 0
        for shard, range_, k in zip(table.column("shard").to_pylist(), table.column("range").to_pylist(), keys, strict=True):
            mine = which[done : done + len(k)]
            done += len(k)
            shared = shards[mine] > 1
            if shared.any():
                out.append((shard, range_, np.packbits(shared).tobytes(), np.packbits(shared & (total[mine] >= hot)).tobytes()))
        return pa.Table.from_batches([_batch(out, _MASKS)])

    return run


def _bytes_at(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of slices of text, one after the other."""
    ends = np.cumsum(sizes)
    return text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _inside(s: _Shard, length: int, bits: int, out_bits: int, masks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """What a shard settles by its own suffix array, and what it asks the others.

    Gives the windows that a document of the shard with a smaller rank has as well; windows that repeat
    within a document, with the first one; and for each range, the windows that other shards may have, each
    distinct one once, as slices of text with the start, the number of windows and the rank of the document.
    """
    by = {m["range"]: m for m in masks}
    cross, hot = np.zeros(len(s.keys), bool), np.zeros(len(s.keys), bool)
    for r, at in s.slices(bits):
        if m := by.get(r):
            n = at.stop - at.start
            cross[at] = np.unpackbits(np.frombuffer(m["shared"], np.uint8))[:n]
            hot[at] = np.unpackbits(np.frombuffer(m["hot"], np.uint8))[:n]
    key = s.key_of[s.run] if len(s.run) else np.empty(0, np.int32)
    ask = cross[key]
    gone, same = np.zeros(len(s.at), bool), (np.empty(0, np.int64), np.empty(0, np.int64))
    twin = np.flatnonzero(s.several[key])
    if len(twin):
        # the text of these windows alone; a window's bytes stay together
        edge = np.zeros(len(s.text) + 1, np.int32)
        np.add.at(edge, s.at[twin], 1)
        np.add.at(edge, s.at[twin] + length, -1)
        used = np.cumsum(edge[:-1]) > 0
        place = np.cumsum(used, dtype=np.int32) - 1
        window, group = window_groups(s.text[used], place[s.at[twin]], length)
        back = np.full(int(used.sum()), -1)
        back[place[s.at[twin]]] = twin
        window = back[window]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[heads, len(group)])
        least = np.repeat(np.minimum.reduceat(s.rank(window), heads), sizes)
        mine = s.rank(window) == least
        first = np.repeat(np.minimum.reduceat(np.where(mine, window, _LAST), heads), sizes)
        gone[window[~mine]] = True
        repeats = mine & (window != first)
        ask[window[repeats]] = False
        ask &= ~gone
        repeats &= cross[key[window]]
        order = np.argsort(window[repeats])
        same = (s.at[window[repeats]][order], s.at[first[repeats]][order])
    asked = np.flatnonzero(ask)
    lone = hot[key[asked]]
    new = np.ones(len(asked), bool)
    new[1:] = (np.diff(asked) != 1) | (np.diff(s.run[asked]) != 0) | lone[1:] | lone[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.r_[first, len(asked)])
    at = asked[first]
    range_ = s.keys[key[at]] >> (s.key_bits - out_bits)
    if lone.any():
        # windows of an anchor that very many documents have are dealt by all their bytes
        w, start = words(s.text), s.at[at[lone[first]]]
        own = np.zeros(len(start), np.uint64)
        for offset in sorted({*range(0, length - 7, 8), max(0, length - 8)}):
            own = mixed(own ^ w[start + offset])
        range_[lone[first]] = (own >> np.uint64(64 - out_bits)).astype(np.int64)
    order = np.argsort(range_, kind="stable")
    range_, at, counts = range_[order], at[order], counts[order]
    starts, sizes = s.at[at].astype(np.int64), counts + length - 1
    flat, ends = _bytes_at(s.text, starts, sizes), np.r_[0, np.cumsum(sizes)]
    asks = [(int(range_[a]), _pack(starts[a:b]), _pack(counts[a:b]), _pack(s.rank(at[a:b])), _squeeze(flat[ends[a] : ends[b]].tobytes())) for a, b in _runs(range_)]
    return s.at[gone], *same, asks


def _search_shards(length: int, key_bits: int, bits: int, out_bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for shard, ids, lengths, text, masks in zip(*(batch.column(c) for c in ("shard", "ids", "lengths", "text", "masks")), strict=True):
                s = _Shard(ids.as_py(), lengths.as_py(), text.as_py(), length, key_bits)
                gone, repeat, of, asks = _inside(s, length, bits, out_bits, masks.as_py() or [])
                number = shard.as_py()
                yield _batch([(-1 - (number * 0x9E3779B1 >> 8) % (1 << out_bits), number, _pack(gone), _pack(repeat), _pack(of), None), *((r, number, a, b, c, d) for r, a, b, c, d in asks)], _FOUND)

    return run


def _merge(length: int, run_windows: int):
    """Which windows of a range have an equal one in another shard, in a document of a smaller rank.

    Windows are sorted to runs of `run_windows` at most, whatever shards they come from, with the smallest rank of each distinct
    window; then each run's windows are looked up in the other runs by binary search. Asked-for windows are distinct in
    their shard. Of anchors that occur very often, each window goes to a range by its own bytes, so what a range
    gets is bounded by the number of shards, not by how many documents share an anchor.
    """

    def run(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:
            return table.select(["shard", "starts", "counts", "ranks"]).add_column(1, "flags", pa.nulls(len(table), pa.binary())).cast(_FLAGS)
        kind = f"S{length}"
        shards, starts, ranks, windows = [], [], [], []
        for shard, at, n, rank, text in zip(*(table.column(c).to_pylist() for c in ("shard", "starts", "counts", "ranks", "text")), strict=True):
            at, n, rank = _unpack(at), _unpack(n), _unpack(rank)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sizes = n + length - 1
            begin = np.repeat(np.cumsum(sizes) - sizes, n) + step
            flat = np.frombuffer(_expand(text), np.uint8)
            windows.append(np.lib.stride_tricks.sliding_window_view(flat, length)[begin].reshape(-1).view(kind))
            starts.append(np.repeat(at, n) + step)
            ranks.append(np.repeat(rank, n))
            shards.append(np.full(len(step), shard))
        runs, ahead = [], 0
        while ahead < len(windows):
            take, n = ahead, 0
            while take < len(windows) and (n == 0 or n + len(windows[take]) <= run_windows):
                n += len(windows[take])
                take += 1
            w, rank = np.concatenate(windows[ahead:take]), np.concatenate(ranks[ahead:take])
            order = np.argsort(w, kind="stable")
            w = w[order]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            least = np.minimum.reduceat(rank[order], first)
            group = np.empty(len(w), np.int64)
            group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w)]))
            runs.append((w[first], least, group, rank, np.concatenate(shards[ahead:take]), np.concatenate(starts[ahead:take])))
            windows[ahead:take] = [None] * (take - ahead)
            ahead = take
        out = []
        for i, (w, least, group, rank, shard, start) in enumerate(runs):
            best = least.copy()
            for j, (other, theirs, *_) in enumerate(runs):
                if i != j:
                    at = np.minimum(np.searchsorted(other, w), len(other) - 1)
                    hit = other[at] == w
                    best[hit] = np.minimum(best[hit], theirs[at[hit]])
            flag = best[group] < rank
            order = np.lexsort((start[flag], shard[flag]))
            shard, start = shard[flag][order], start[flag][order]
            out += [(int(shard[a]), _pack(start[a:b]), None, None, None) for a, b in _runs(shard)]
        return pa.Table.from_batches([_batch(out, _FLAGS)])

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def _remove(length: int, with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, lengths, text, gone, repeat, of, flags in zip(*(batch.column(c) for c in ("ids", "lengths", "text", "starts", "counts", "ranks", "flags")), strict=True):
                whole, ends = np.frombuffer(_expand(text.as_py()), np.uint8), _unpack(lengths.as_py())
                asked = np.concatenate([np.empty(0, np.int64), *(_unpack(f) for f in flags.as_py() or [])])
                flagged = np.zeros(len(whole) + 1, bool)
                flagged[asked] = True
                repeat = _unpack(repeat.as_py())[flagged[_unpack(of.as_py())]]
                flagged[repeat] = flagged[_unpack(gone.as_py())] = True
                edge = np.zeros(len(whole) + length + 1, np.int32)
                edge[:-length] += flagged
                edge[length:] -= flagged
                removed = np.cumsum(edge)[: len(whole)] > 0
                # a run ends with its document
                begins, stops = removed.copy(), removed.copy()
                begins[1:] &= ~removed[:-1]
                stops[:-1] &= ~removed[1:]
                inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(whole))]
                begins[inner] = removed[inner]
                stops[inner - 1] = removed[inner - 1]
                begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                rows = []
                for id_, a, b in zip(ids.as_py(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    i, j = np.searchsorted(begins, [a, b])
                    kept = whole[a:b][~removed[a:b]].tobytes() if j > i else whole[a:b].tobytes()
                    rows.append((id_, b - a, b - a - len(kept), int(j - i), hashlib.sha256(kept).hexdigest(), np.stack([begins[i:j] - a, stops[i:j] - a], axis=1).ravel().tolist(), kept if with_text else None))
                yield _batch(rows, _RESULT)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _bits(n: float, least: int) -> int:
    """So many bits that each of 2**bits ranges gets one part of n."""
    return max(least, int(np.ceil(np.log2(max(1.0, n)))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = True, shard_bytes: int = SHARD_BYTES, hot_anchors: int = HOT_ANCHORS, run_windows: int = RUN_WINDOWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) for every row of `docs`.

    Texts are UTF-8 bytes. A byte is removed if it is covered by a string of `length` bytes that also starts in a document
    with a smaller id; all strings are judged on the input. `spans` lists the start and end of each maximal
    removed run, and `kept` is what is left, in bytes (a cut can fall inside a character; null without `with_text`).

    How: documents are packed to shards. Each window of `length` bytes has an anchor, the least hash of the
    grams in it. Shards exchange their anchors, by ranges and compressed, and learn which ones another shard has too; text
    that shares no anchor can't repeat, and stays out of what follows. A shard sorts the windows whose anchors occur in it more than
    once in a suffix array, with common prefixes: that settles repeats inside. Of each distinct window
    whose anchor another shard has, one goes to a task for its range of anchors, where the shards' sorted windows
    meet by binary search. Anchors decide only what is compared: results rest on the bytes.

    Nothing is collected, and no task holds more than a shard, or a range whose size is set by
    the bytes of all texts. Shards are kept compressed in the shared folder until the result is written there.

    A null text is empty. Nulls as ids come after all ids, and rows with the same id don't remove each other's bytes. Of documents with
    equal texts, the smallest id stays whole. Texts shorter than `length` stay. Other columns are ignored, so they may have any name.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_folder(spark, "shards")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base.mapInArrow(_shards(shard_bytes), _ddl(_SHARD)).write.option("compression", "uncompressed").parquet(folder)
    shards = spark.read.parquet(folder)
    n_bytes = shards.agg(F.sum("n_bytes")).first()[0] or 0
    # about a fifteenth of the bytes start a new anchor
    key_bits = min(62, _bits(n_bytes / 15, 12) + SPARE_BITS)
    bits, out_bits = _bits(n_bytes / 15 / RANGE_ANCHORS, 6), _bits(n_bytes / RANGE_BYTES, 8)
    listed = shards.mapInArrow(_list_anchors(length, key_bits, bits), _ddl(_ANCHORS))
    masks = listed.groupBy("range").applyInArrow(_shared_anchors(hot_anchors), _ddl(_MASKS)).groupBy("shard").agg(F.collect_list(F.struct("range", "shared", "hot")).alias("masks"))
    found = shards.join(masks, "shard", "left").mapInArrow(_search_shards(length, key_bits, bits, out_bits), _ddl(_FOUND))
    told = found.groupBy("range").applyInArrow(_merge(length, run_windows), _ddl(_FLAGS))
    known = told.groupBy("shard").agg(F.collect_list("flags").alias("flags"), *(F.max(c).alias(c) for c in ("starts", "counts", "ranks")))
    out = cut(shards.join(known, "shard").mapInArrow(_remove(length, with_text), _ddl(_RESULT)))
    remove_folder(spark, folder)
    return out


def op12_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op12_suffix": op12_suffix}
ORACLES = {
    "op12_suffix": """
        WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS nr, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        piece AS MATERIALIZED (SELECT nr, doc_id, 256 * p AS start, substr(x, 512 * p + 1, 612) AS x, least(256, strlen(x) // 2 - 256 * p) AS n FROM doc, unnest(range((strlen(x) // 2 + 255) // 256)) t(p)),
        byte AS MATERIALIZED (SELECT nr, doc_id, start + i AS i, substr(x, 2 * i + 1, 100) AS w FROM piece, unnest(range(n)) t(i)),
        least AS MATERIALIZED (SELECT w, min(doc_id) AS first FROM byte WHERE strlen(w) = 100 GROUP BY w HAVING count(*) > 1),
        judged AS (SELECT nr, i, left(w, 2) AS b, i - max(CASE WHEN first < coalesce(doc_id, 9223372036854775807) THEN i END)
                OVER (PARTITION BY nr ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM byte LEFT JOIN least USING (w)),
        run AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY nr ORDER BY i) AS starts FROM judged),
        summed AS (SELECT nr, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM run GROUP BY nr)
        SELECT doc_id, strlen(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM doc LEFT JOIN summed USING (nr)"""
}
