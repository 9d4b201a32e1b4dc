"""Nulls, empty and very long texts, repeated rows, empty tables, and columns with clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat_format, decontamination, exact_dedup, mixing, near_dedup, quality, secret_scan, token_rollup, url_filter, warc
from lexmill.llm._boosting import fit

LONG = " ".join(f"word{i % 5000} w{i}" for i in range(120_000))
CLASH = "row long, key string, node long, comp string, name string, level int, score double, kept boolean, hits int, found string, secrets string, _n int, h long, ix int, sha string"
TEXTS = [None, "", " ", LONG, LONG + " end", "password = hunter2hunter2", "same text of several words here", "same text of several words here", "🎉 émoji ünïcode", "short"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "de", "src1", 10), (None, "null id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_duplicates(docs, none):
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(TEXTS) + 2
    got = {r.doc_id: r for r in out}
    assert got[3].class_id == got[4].class_id == 3 and got[3].class_size == 2
    assert got[6].class_id == got[7].class_id == 6 and got[7].class_size == 3 and got[6].kept and not got[7].kept
    assert got[0].class_id == got[1].class_id == 0 and got[2].class_id == 2  # null is empty; a blank is another text without words
    assert got[5].class_size == 1
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_at_exactly_the_threshold(spark):
    """A text, and the same text with more words: the similarity is the fraction of their numbers of shingles."""
    from fractions import Fraction

    pairs = [(4 * k - less, 5 * k) for k in range(1, 31) for less in (0, 1)]
    rows = [(2 * i + j, " ".join(f"p{i}w{x}" for x in range(n + 4))) for i, pair in enumerate(pairs) for j, n in enumerate(pair)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, pair in enumerate(pairs):
        assert (got[2 * i].class_id == got[2 * i + 1].class_id) == (Fraction(*pair) >= Fraction(4, 5)), pair


def test_exact_duplicates(docs, none):
    out = exact_dedup.exact_duplicates(docs, block_bytes=100_000).collect()
    assert len(out) == len(TEXTS) + 2
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert got[0][0].keep_id == 1 and not got[0][0].kept and got[1][0].group_size == 2
    assert got[6][0].keep_id == 7 and sum(r.kept for r in got[7]) == 1 and got[6][0].group_size == 3
    assert got[3][0].keep_id == 3 and got[4][0].keep_id == 4 and got[2][0].group_size == 1
    assert got[None][0].kept and got[None][0].keep_id is None
    assert got[8][0].text_sha256 == hashlib.sha256(TEXTS[8].encode()).hexdigest()
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_block_names_survive_colliding_hashes(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [1, 3])], "row long, hashes array<long>")
    blocks = spark.createDataFrame([(0, 0, b"a", 1), (0, 1, b"x", 2), (1, 0, b"b", 1), (1, 1, b"x", 2), (2, 0, b"a", 1), (2, 1, b"y", 3)], "row long, ix int, block binary, h long")
    got = {(r.row, r.ix): r.name for r in exact_dedup._block_names(rows, blocks).collect()}
    assert got[0, 0] == got[2, 0] != got[1, 0] and got[0, 1] == got[1, 1] != got[2, 1] and len(set(got.values())) == 4


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(1, "Same TEXT of several words here"), (2, None), (3, ""), (4, "émoji"), (5, "émoji"), (6, " ".join(f"w{i} word{(i + 1) % 5000}" for i in range(30)))], "item_id long, text string")
    for limit in (10_000, 0):  # the hash set, and the join for benchmarks of any size
        got = by_id(decontamination.contamination(docs, bench, set_windows=limit))
        assert got[6].contaminated and got[6].n_hit == 6 and got[6].items == ["1"]
        assert got[8].n_hit == 1 and got[8].items == ["4", "5"] and got[8].n_words == 3
        assert got[0].n_words == 0 and not got[0].contaminated and got[0].n_items == 0
        assert got[3].n_words == 240_000 and got[3].n_hit == 60 and got[3].items == ["6"] and not got[3].contaminated
    assert decontamination.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.contamination(none, bench).count() == 0


def test_stages_drop_rows_and_not_ids(spark, tmp_path):
    """Null and repeated ids: a stage drops the copy, near copy or contaminated row, and no other row of its id."""
    import corpus_pipeline as P

    words = lambda tag, n=40: [f"{tag}{i}" for i in range(n)]
    near = lambda tag, i: " ".join(words(tag, 120) + [f"end{i}"])
    schema = "doc_id long, text string, source string"
    frame = lambda rows: spark.createDataFrame([(*r, "s") for r in rows], schema)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stay = lambda rows: sorted(rows, key=str)

    copies = [(5, "X"), (5, "Y"), (9, "X"), (None, "Z"), (None, "alone"), (1, "Z"), (None, "twice"), (None, "twice"), (None, None), (None, "")]
    got = left(P.drop_copies(spark, frame(copies), ""))
    assert stay((i, t or "") for i, t in got) == stay([(5, "Y"), (9, "X"), (None, "alone"), (1, "Z"), (None, "twice"), (None, "")])

    a, b, c = (tuple(near(t, i) for i in range(3)) for t in "abc")
    one = [(7, a[0]), (7, a[1]), (7, "other text of id seven"), (8, a[2]), (None, b[0]), (3, b[1]), (None, "clean one"), (None, c[0]), (None, c[1]), (4, "twice here"), (4, "twice here")]
    got = left(P.drop_near_copies(spark, frame(one), ""))
    assert len(got) == 6 and sum(x in got for x in ((7, a[0]), (7, a[1]))) == 1 and sum(x in got for x in ((None, c[0]), (None, c[1]))) == 1
    assert {(7, "other text of id seven"), (3, b[1]), (None, "clean one"), (4, "twice here")} <= set(got)

    spark.createDataFrame([(1, " ".join(words("q", 20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = " ".join(words("q", 20))
    rows = [(None, dirty), (None, "clean"), (6, dirty), (6, "clean too"), (None, None)]
    assert left(P.decontaminate(spark, frame(rows), str(tmp_path))) == stay([(None, "clean"), (6, "clean too"), (None, None)])


def test_remove_spans(spark):
    df = spark.createDataFrame([("Keep, the BAD part; stays",)], "text string").withColumn("spans", F.expr("array(struct(3 as start, 4 as end))"))
    assert df.select(decontamination.remove_spans(F.col("text"), F.col("spans"))).first()[0] == "Keep the stays"


def test_secrets(docs, none):
    got = by_id(secret_scan.find_secrets(docs, owner=F.col("source")))
    assert [(s.start, s.end) for s in got[5].secrets] == [(0, 25)]
    assert got[0].secrets == [] and got[3].secrets == []
    assert secret_scan.find_secrets(none).count() == 0


def test_secret_rules(spark):
    t = "password=token:  \"abcdefgh1 AKIA" + "X" * 12 + " AKIAX " + "a" * 31 + "g" + "0" * 32 + "\x00 😀 TOKEN: 12345678"
    rows = [(i, t if i < 4 else f"api_key='only{i}owner99'", f"o{i}") for i in range(6)]
    got = by_id(secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, o string"), owner=F.col("o")))
    spans = [(list(secret_scan.KINDS)[s.kind], t[s.start : s.end]) for s in got[0].secrets]
    assert spans == [("access", "AKIA" + "X" * 12), ("hex", "0" * 32), ("assign", "TOKEN: 12345678")]
    assert {s.verdict for s in got[0].secrets} == {"example"} and got[4].secrets[0].verdict == "live"


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "WARC/1.1\r\n\r\n" + "é\n" * 30_000), (None, "http://e", "alone"), (7, "http://f", "twice"), (7, "http://f", "twice")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit("x"))
    warc.write_warc(df, str(tmp_path / "w"), chunk_bytes=1000)
    table = warc.read_warc(spark, str(tmp_path / "w"), chunk_bytes=700)
    last = table.where("last").collect()
    got = {r.page_id: r for r in last}
    assert len(last) == len(pages) and all(r.intact for r in last)
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 4) and got[2].record_type == "response"
    assert got[3].refers_to == 4 and got[None].record_type == "response" and got[7].record_type == "response"
    chunks = sorted((r.chunk_no, bytes(r.data)) for r in table.where("page_id = 5").collect())
    assert b"".join(c for _, c in chunks) == pages[4][2].encode() and max(len(c) for _, c in chunks) <= 700
    warc.write_warc(df.where("false"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_small_payloads_are_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), least_bytes=3)
    got = {r.page_id: r.refers_to for r in warc.read_warc(spark, str(tmp_path / "w")).where("last").collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_chats(spark):
    rows = [(1, 2, "assistant", "<|end|>&amp;[x]"), (1, 1, "assistant", None), (1, 0, "user", "hi"), (2, None, None, "x"), (None, 0, "a|>b", "</s>[INST]"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("blocks", F.lit(1)).withColumn("turns", F.lit(2))
    out = chat_format.format_chats(df).withColumn("back", chat_format.read_chats(F.col("formatted"))).collect()
    got = {r.conv_id: r for r in out}
    assert [tuple(t) for t in got[1].back] == [("user", "hi"), ("assistant", ""), ("assistant", "<|end|>&amp;[x]")]
    assert [tuple(t) for t in got[2].back] == [("", "x")] and [tuple(t) for t in got[None].back] == [("a|>b", "</s>[INST]")] and len(got[3].back) == 2
    assert got[1].formatted.count(chat_format.END) == 2  # adjacent turns of one role share a block
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["", "&lt;|end|>&amp;amp;&#91;x]"]
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/a?x#y", "http://a.example.com/en/", "http://x.net/fr/1", "http://com", "http://org/\nline", "http://notexample.com/en/x", "x://h#/en/", "ftp://É.example.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit("x")).withColumn("s", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None) and got[2].host == ""
    assert (got[3].host, got[3].rule, got[3].verdict) == ("www.example.com", "www.example.com/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("example.com/en/", "block") and got[5].rule == "net/fr/"
    assert got[6].rule is None and got[7].path == "/\nline" and got[8].rule == "com/" and got[9].path == "" and got[10].host == "É.example.com"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(df.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules=[]).collect()} == {"allow"}


def test_url_models_tell_hosts_apart(spark):
    rows = [(i, f"http://good{i % 7}.com/page") for i in range(50)] + [(100 + i, f"http://spam{i % 7}.net/es/page") for i in range(50)] + [(200, "http://good3.org/page"), (201, "http://spam3.org/es/page")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200].score > got[201].score


@pytest.mark.parametrize(("good", "bad"), [("shop7", "shop8"), ("кот", "пёс"), ("abcabdab", "abdabcab"), ("ABLE", "able")])
def test_url_models_see_characters_and_long_contexts(spark, good, bad):
    """Pairs that a model of three folded characters can't tell apart: digits, letters that aren't ASCII, equal trigrams, case of the path."""
    rows = [(i, f"http://a.com/{good}/") for i in range(30)] + [(100 + i, f"http://a.net/es/{bad}/") for i in range(30)] + [(200, f"http://a.org/{good}/"), (201, f"http://a.org/{bad}/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200].score > got[201].score + 0.05


def test_url_scores_are_those_of_a_plain_version(spark):
    from test_brute import url_scores_by_hand

    rng = np.random.default_rng(4)
    urls = [f"http://{'abé7'[i % 4]}{rng.integers(0, 30)}.{('com', 'net', 'org')[i % 3]}/{('es', 'fr', 'X')[i // 3 % 3]}/{'w' * int(rng.integers(0, 20))}{rng.integers(0, 9)}" for i in range(150)] + ["", "\U0001f600", "http://long.org/" + "y" * 20_000]
    urls += urls[:40]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    held = {r.url for r in df.where(f"pmod(xxhash64(url), {url_filter.HELD_OUT}) = 0").collect()}
    want = url_scores_by_hand([(u, got[i].verdict if got[i].rule and u not in held else None) for i, u in enumerate(urls)])
    assert all(got[i].score == pytest.approx(want[u], abs=1e-9) for i, u in enumerate(urls))


def test_mixing(docs, none):
    out = mixing.mix(docs, mixing.dimensions()).collect()
    assert len(out) == len(TEXTS) + 2 and not any(r.mix_sampled for r in out if r.mix_tokens == 0)
    assert all(0 <= r.mix_probability <= 1 for r in out)
    assert mixing.mix(none, mixing.dimensions()).count() == 0


def test_raking_meets_targets_and_both_ways_agree(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}", f"l{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    dims, goals = {"source": F.col("source"), "lang": F.col("lang")}, {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"l0": 0.4, "l1": 0.6}}
    small = mixing.mix(df, dims, goals, keep_share=0.3)
    share = {r.source: r.w for r in small.groupBy("source").agg(F.sum(F.col("mix_weight") * F.col("mix_tokens")).alias("w")).collect()}
    total = sum(share.values())
    assert share["s0"] / total == pytest.approx(0.5, abs=1e-6) and share["s2"] / total == pytest.approx(0.2, abs=1e-6)
    expected = small.agg(F.sum(F.col("mix_probability") * F.col("mix_tokens")), F.sum("mix_tokens")).first()
    assert expected[0] / expected[1] == pytest.approx(0.3, abs=1e-6)
    large = mixing.mix(df, dims, goals, keep_share=0.3, driver_cells=0)
    a, b = ({r.doc_id: r.mix_probability for r in x.collect()} for x in (small, large))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-5


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, quality int")
    trees = quality.train(docs, labels)
    out = quality.with_score(docs, trees).collect()
    assert len(out) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert quality.with_score(none, quality.train(none, labels.where("false"))).count() == 0


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = fit(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p[:50], [walk(r) for r in x[2000:2050]])
    assert fit(np.zeros((0, 5)), np.zeros(0)).score(np.zeros((2, 5))).tolist() == [0.5, 0.5]


def test_rollup(spark, docs, none, tmp_path):
    schema = "source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    r.commit("1", batch(("a", "en", "v1", None, 10), ("a", "en", "v1", None, 5), (None, None, "v1", None, 1)))
    for _ in range(3):
        r.commit("2", batch(("a", "en", "v1", 10, 12), ("a", "en", "v1", None, None)))
    got = {(x.source, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}
    assert got == {("a", "v1"): (2, 17), (None, "v1"): (1, 1)}
    r.compact()
    r.compact()
    r.commit("2", batch(("a", "en", "v1", None, 1000)))  # delivered again after it was folded
    r.commit("3", batch((None, None, "v1", 1, None)))
    r.commit("4", batch())
    assert {(x.source, x.docs, x.tokens) for x in r.totals().collect()} == {("a", 2, 17)}
    counts = token_rollup.counted(docs.where("doc_id = 5 or doc_id = 0")).collect()
    assert {(c.doc_id, c.words, c.marked_words) for c in counts} == {(0, 0, 0), (5, 3, 3)} and all(c.bpe >= c.words for c in counts)
    assert token_rollup.counted(none).count() == 0


def test_block_names_are_ranks_however_rows_are_dealt(spark):
    rows = spark.createDataFrame([((i * 7919) % 1000, (i * 31) % 5) for i in range(1000)], "a long, b long").distinct()
    want = {tuple(r): n for n, r in enumerate(sorted(map(tuple, rows.collect())))}
    for parts, tasks in ((3, 1), (8, 5), (1, 16)):
        assert {(r.a, r.b): r.name for r in exact_dedup._numbered(rows.repartition(parts), tasks, "a", "b").collect()} == want


def test_a_very_long_conversation(spark):
    """Spans and texts of 3,000 turns, and one turn of 300,000 characters outside the basic plane, are found again."""
    rows = [(1, i, ("user", "assistant")[i // 2 % 2], f"<t{i}> é😀" * (i % 4)) for i in range(3000)] + [(1, 3000, "assistant", "😀[" * 150_000)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.select(chat_format.read_chats(F.col("formatted")).alias("turns"), chat_format.under_spans(F.col("formatted"), F.col("loss_spans")).alias("under")).first()
    assert [tuple(t) for t in r.turns] == [(role, text) for _, _, role, text in rows]
    assert [x.replace("&#91;", "[").replace("&lt;", "<") for x in r.under] == [text for _, _, role, text in rows if role == "assistant"]


def test_mixing_keeps_the_columns_of_its_input(spark):
    df = spark.createDataFrame([(1, "a b", "s", "x", 5, "y"), (2, "c", "t", "z", 6, "w")], "doc_id long, text string, source string, mix_batch string, mix_tokens int, _mix_source string")
    out = mixing.mix(df, {"source": F.col("source")}, {"source": {"s": 1, "t": 1, "absent": 2}}, keep_share=1.0)
    assert out.columns == ["doc_id", "text", "source", "mix_batch", "_mix_source", "mix_source", "mix_tokens", "mix_weight", "mix_probability", "mix_sampled"]
    got = by_id(out)
    assert (got[1].mix_batch, got[1]._mix_source, got[1].mix_tokens, got[1].mix_source) == ("x", "y", 2, "s") and got[1].mix_sampled
    assert got[1].mix_weight == pytest.approx(0.75) and got[2].mix_weight == pytest.approx(1.5)


def test_mixing_tells_of_targets_that_cannot_be_met(spark):
    df = spark.createDataFrame([(1, "a", "s", "x"), (2, "b", "t", "y")], "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="has not met"):
        mixing.mix(df, {"source": F.col("source"), "lang": F.col("lang")}, {"source": {"s": 1, "t": 1}, "lang": {"x": 1, "y": 9}})


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    df = spark.createDataFrame([(None, f"text number {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    assert 140 < mixing.mix(df, {"source": F.col("source")}, keep_share=0.5).where("mix_sampled").count() < 260


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    schema = "source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    one = spark.createDataFrame([("a", "en", "v1", None, 10)], schema)
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    r.commit("1", one)
    sums = r._sums
    monkeypatch.setattr(r, "_sums", lambda *a: r.commit("2", one) or sums(*a))
    r.compact()
    monkeypatch.undo()
    r.commit("2", one)
    r.commit("1", one)
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(2, 20)]
    r.compact()
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(2, 20)]


def test_the_first_commit_of_a_batch_counts_before_and_after_compaction(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    batch = lambda n: spark.createDataFrame([("a", "en", "v1", None, n)], schema)
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    r.commit("1", batch(10))
    r.commit("1", batch(99))
    assert r.totals().first().tokens == 10
    r.compact()
    r.commit("1", batch(99))
    assert r.totals().first().tokens == 10


def test_stages_of_empty_tables_and_with_clashing_columns(spark, docs, tmp_path):
    """All stages take documents with columns of other operators' names, and give them back; of no documents they make none."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = docs.withColumns({c: F.lit("x") for c in ("_score", "_sha", "row", "mix_batch", "gram", "pos", "w", "class_id", "keep_id", "bands")})
    extra.write.parquet(f"{tmp_path}/extra.parquet")
    for df in (spark.read.parquet(f"{tmp_path}/extra.parquet"), spark.read.parquet(f"{tmp_path}/extra.parquet").where("false")):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns
            assert (out.count() > 0) == (df.count() > 0)
        assert {*df.columns} <= {*P.STAGES[-1][1](spark, df, str(tmp_path)).columns}
