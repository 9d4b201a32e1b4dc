"""Vector codes, removal of repeats and Merkle proofs against plain versions, and their edges."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import _hamerly, _suffix, merkle_manifest, suffix_dedup, vector_codes

# ---- codes of vectors ----


def codes_by_hand(rows, parts=8, k=16, rounds=6):
    """{(id, order): (code, error)} and all codebooks, with plain integers."""
    kept = sorted((i is None, i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    ints = [[int(np.floor(4096 * x)) for x in v] for _, _, v in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for v in ints] for p in range(parts)]
    books = [list(map(tuple, c[:k])) for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, books[p]) for v in cut[p]]
            for e in range(len(books[p])):
                members = [v for v, c in zip(cut[p], own, strict=True) if c == e]
                if members:
                    books[p][e] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    out = []
    for n, (_, i, _) in enumerate(kept):
        best = [near(cut[p][n], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in best), sum(far(cut[p][n], books[p][c]) for p, c in enumerate(best))))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [3, 90])
def test_codes_with_ties_nulls_and_repeats(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.integers(-3, 4, 16).astype(float).tolist()) for i in rng.integers(0, n, n)]  # coarse values: many ties
    rows = [(i, v) for j, (i, v) in enumerate(rows) if i not in {r[0] for r in rows[:j]}]
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (None, [0.1] * 16)]
    odd = [(7000, None), (7001, [None] + [0.0] * 15), (7002, [float("nan")] + [0.0] * 15), (7003, [float("-inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, None if (i or 0) % 3 == 0 else (i or 0) % 3, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, label int, code string, row int")
    got = vector_codes.encode(df).collect()
    want, sha = codes_by_hand(rows)
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in got) == sorted((i is None, i, c, e) for i, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {sha}
    for label in (None, 1, 2):
        same = [r for r in got if r.label == label]
        assert {r.label_error for r in same} <= {sum(r.error for r in same)}


def test_codes_of_nothing_and_of_vectors_that_do_not_fit(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.encode(spark.createDataFrame([], schema)).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.encode(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    with pytest.raises(Exception, match="equal parts"):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 9, 1)], schema)).collect()
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode(spark.createDataFrame([(1, [1e9] * 8, 1)], schema)).collect()


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))).astype(np.int64)
    entries, moved, scans = x[:16].copy(), np.zeros(16), []
    for i in range(8):
        rounds = _hamerly.Rounds(entries, moved)
        if i == 0:
            code, upper, lower = rounds.first(x)
        else:
            code, upper, lower, scanned = rounds.next(x, code, upper, lower)
            scans.append(scanned)
        d = _hamerly.squared(x, entries)
        assert (code == d.argmin(axis=1)).all()
        assert (upper.astype(float) >= np.sqrt(d[np.arange(len(x)), code])).all()
        d[np.arange(len(x)), code] = 1 << 60
        assert (lower.astype(float) <= np.sqrt(d.min(axis=1))).all()
        new = entries.copy()
        for e in np.unique(code):
            new[e] = x[code == e].sum(axis=0) // (code == e).sum()
        moved, entries = ((new - entries) ** 2).sum(axis=1), new
    assert scans[-1] < len(x) // 4


# ---- removal of repeats ----


def repeats_by_hand(rows, length=50):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, t in texts:
        for at in range(len(t) - length + 1):
            w = t[at : at + length]
            least[w] = min(least.get(w, float("inf")), rank(i))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - length + 1):
            if least[t[at : at + length]] < rank(i):
                gone[at : at + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).tolist()
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), len(edges) // 2, edges, kept, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts():
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(14) for _ in range(4)]
    rows = [(i, " ".join([text(rng.integers(0, 12)), *(passages[j] for j in rng.integers(0, 4, rng.integers(0, 3))), text(rng.integers(0, 12))])) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 9)]  # copies
    rows += [(200, "z" * 400), (201, "z" * 120), (202, "y" + "z" * 60), (203, "ab" * 200), (204, "ba" * 40), (205, passages[0] * 6)]
    rows += [(206, "short"), (207, ""), (208, None), (209, "x" * 49), (210, "x" * 50), (211, "x" * 51), (None, rows[3][1]), (None, rows[4][1]), (3, rows[4][1]), (5, rows[5][1]), (300, "\x00" * 90), (301, "\x00" * 70 + "q"), (302, "日本語" * 30)]
    return rows


@pytest.mark.parametrize(("shard", "hot", "run"), [(1 << 22, 2000, 250_000), (700, 2000, 250_000), (700, 2, 250_000), (300, 3, 40)])
def test_repeats_in_and_across_shards(spark, shard, hot, run):
    """One shard; many; every shared anchor dealt by windows; runs of few windows that meet by binary search."""
    rows = repeating_texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, kept int").repartition(5)
    got = suffix_dedup.remove_repeats(df, shard_bytes=shard, hot_anchors=hot, run_windows=run).collect()
    tell = lambda rs: sorted(rs, key=repr)
    assert tell([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, list(r.spans), bytes(r.kept), r.kept_sha256) for r in got]) == tell(repeats_by_hand(rows))
    assert sum(r.n_removed for r in got) > 3000


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_window_groups_are_the_distinct_windows_in_order(letters):
    rng = np.random.default_rng(letters)
    for size in (0, 1, 49, 50, 51, 300, 900):
        text = rng.integers(0, letters, size).astype(np.uint8)
        text = np.r_[text, text[: size // 2], text[size // 3 :]].astype(np.uint8)
        b, starts = text.tobytes(), np.arange(max(0, len(text) - 49))
        at, group = _suffix.window_groups(text, starts, 50)
        windows = [b[i : i + 50] for i in at.tolist()]
        assert windows == sorted(windows) and sorted(at.tolist()) == starts.tolist()
        assert all((windows[i] == windows[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(windows)))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 300_000).astype(np.uint8)
    text[200_000:200_500] = text[1000:1500]
    found = _suffix.anchors(text, 50)
    assert (found[200_000:200_451] == found[1000:1451]).all() and len(np.unique(found)) > 15_000


# ---- proofs ----


def proofs_by_hand(rows):
    h = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, (r[0], r[1], r[2], r[3], r[4])))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for nodes in levels[:-1]:
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            out.append((run[: at % 8], run[at % 8 + 1 :]))
            at //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [grow([leaf(r) for r in g]) for g in groups]
    top = grow([t[-1][0] for t in trees])
    out = []
    for n, (g, tree) in enumerate(zip(groups, trees, strict=True)):
        for at, r in enumerate(g):
            steps = path(tree, at) + path(top, n)
            changed = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 or r[4] is None else (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
            acc = leaf(changed)
            for left, right in steps:
                acc = h(*left, acc, *right)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], h(*(x for a, b in steps for x in (*a, *b))), acc, acc == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 73, None: 1, "de": 8, "É": 9, "": 2}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_proofs(spark, sizes):
    rows, n = [], 0
    for lang, k in sizes.items():
        for i in range(k):
            rows.append((n, "s" if i % 4 else None, lang, i if i % 5 else None, ["Aa É" * i, "lower", None, ""][i % 4]))
            n += 1
    rows += [(None, "s", next(iter(sizes)), 1, "X"), (0, "other", next(iter(sizes)), 1, "Y")] if len(rows) > 1 else []
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int").repartition(3)
    found = merkle_manifest.proofs(df, merkle_manifest.FIELDS, merkle_manifest.lowered_by_id)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(proofs_by_hand(rows), key=repr)


def test_proofs_of_repeated_rows_and_of_nothing(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame([(1, "s", "en", 1, "a")] * 20, schema)
    got = merkle_manifest.proofs(df, merkle_manifest.FIELDS).collect()
    assert len(got) == 20 and all(r.verified for r in got) and {r.ix for r in got} == set(range(20))
    assert merkle_manifest.proofs(df.where("false"), merkle_manifest.FIELDS).count() == 0


def test_joins_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text")).to(spark.createDataFrame([], schema).schema)
    tell = lambda: sorted((r.doc_id, r.proof_sha256, r.folded_root) for r in merkle_manifest.proofs(df, merkle_manifest.FIELDS).collect())
    want = tell()
    monkeypatch.setattr(merkle_manifest, "UPPER_NODES", 20)
    assert tell() == want
