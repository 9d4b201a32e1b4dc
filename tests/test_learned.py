"""What is learned between runs: keyed state, stores, clusters, classifiers, spans, quantified constraints."""

import math
import os
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import bootstrap, clusters, extraction, intervals, quantified, store, tfidf
from lexmill.operators.rules import Rule
from lexmill.plans import learned_queries as LQ
from lexmill.streaming import learner

# ---- the learner ----


@pytest.fixture(scope="module")
def evidence(spark, sf_dir, tmp_path_factory):
    """Events as evidence, in files by time, and the folder of the first half."""
    rows = LQ.evidence_of_events(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("text_hash", F.expr("if(ev_id % 50 = 0, null, text_hash)"))
    path = str(tmp_path_factory.mktemp("evidence") / "all")
    rows.coalesce(1).sortWithinPartitions("ts", "ev_id").write.option("maxRecordsPerFile", rows.count() // 6 + 1).parquet(path)
    return rows, path


def _run(spark, rows, source, folder):
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    told, model = learner.run_learner(stream, LQ.GROUPS, LQ.first_model(spark), folder, LQ.RATE)
    order = ["ev_id", "signal"]
    return told.select(*order, "text_hash", "old_label", "suggested", "confidence", "times", "accepted").orderBy(*order).collect(), {(r.label, r.gram): r.log_prob for r in model.collect()}


def test_micro_batches_and_restarts_make_no_difference(spark, evidence, tmp_path):
    rows, path = evidence
    whole = str(tmp_path / "one")
    rows.coalesce(1).write.parquet(whole)
    want, weights = _run(spark, rows, whole, str(tmp_path / "a"))
    got, same = _run(spark, rows, path, str(tmp_path / "b"))
    assert got == want and same == pytest.approx(weights)
    # half of the files, then the others with the same folder, then nothing new
    part = tmp_path / "part"
    part.mkdir()
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    for i, f in enumerate(files):
        shutil.copy(f"{path}/{f}", part / f)
        os.utime(part / f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
        if i == len(files) // 2:
            some, _ = _run(spark, rows, str(part), str(tmp_path / "c"))
            assert 0 < len(some) < len(want)
    for _ in range(2):
        got, same = _run(spark, rows, str(part), str(tmp_path / "c"))
        assert got == want and same == pytest.approx(weights)
    assert any(r.accepted for r in want) and {r.signal for r in want} == {"terms", "inconsistent", "boundary"}


# ---- clusters ----


def test_dense_clusters_give_few_links(spark, monkeypatch):
    """One dense cluster in many blocks, and a chain of others: classes of blocks are linked, not points."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0] + rng.normal(0, 0.01, 2).tolist()) for i in range(600)] + [(1000 + i, [math.cos(i / 10), math.sin(i / 10), 0.0, 0.0]) for i in range(10, 25)] + [(2000, [0.0, 0.0, 1.0, 0.0]), (2001, [0.0] * 4)]
    seen = []
    inner = clusters.components
    monkeypatch.setattr(clusters, "components", lambda nodes, links, col: seen.append((nodes.count(), links.count())) or inner(nodes, links, col))
    got = {r.id: r.cluster for r in clusters.dbscan(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.01, 2, block_rows=50).collect()}
    assert {got[i] for i in range(600)} == {0} and got[2000] == got[2001] == -1
    assert {got[1000 + i] for i in range(10, 25)} == {1011}  # the ends are border points
    (_, first), (nodes, links) = seen
    assert nodes <= 10 and first < 100 and links < 300  # of 600 points


def test_matching_in_blocks_and_without_clusters(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, rng.normal(0, 1, 12).tolist()) for i in range(40)], "id long, vector array<double>")
    table = spark.createDataFrame([(c, rng.normal(0, 1, 12).tolist()) for c in range(11)], "cluster long, centroid array<double>")
    tell = lambda **k: {r.id: (r.cluster, r.distance and round(r.distance, 9)) for r in clusters.match(points, table, "id", **k).collect()}
    want, close = tell(), tell(within=0.5)
    assert {c for c, d in close.values() if c is None} == {None} and all(want[i][1] < 0.5 for i in close if close[i][0] is not None)
    monkeypatch.setattr(clusters, "BLOCK_CLUSTERS", 4)
    assert tell() == want
    assert all(r.cluster is None for r in clusters.match(points, table.where("false"), "id").collect())


def test_descriptions(spark):
    rows = [(1, 5, [0.1] + [0.0] * 5 + [0.5] + [0.0] * 3, ["ab", "bc"]), (2, 5, [0.3] + [0.0] * 5 + [0.5] + [0.0] * 3, ["ab", "zz"]), (3, 7, [0.9] + [0.0] * 9, []), (4, -1, [0.9] + [0.0] * 9, ["ab"])]
    got = {r.cluster: r for r in clusters.describe(spark.createDataFrame(rows, "id long, cluster long, vector array<double>, grams array<string>")).collect()}
    assert got.keys() == {5, 7} and (got[5].cluster_id, got[7].cluster_id) == ("C_000", "C_001")
    assert got[5].label == "数字密集-abbc-前段" and got[5].top_grams == ["ab", "bc", "zz"] and got[7].label == "文本为主-未分类-后段"


# ---- stores ----


def test_replayed_batches_change_nothing_and_broken_ones_are_not_read(spark, tmp_path):
    s = store.PrototypeStore(spark, str(tmp_path / "s"))
    grams = lambda *r: spark.createDataFrame(list(r), "domain string, gram string")
    n = lambda *r: spark.createDataFrame(list(r), "domain string, samples long")
    assert s.domains().count() == 0
    assert s.upsert("a", grams(("x", "ab"), ("x", "bc"), ("y", "ab")), n(("x", 2), ("y", 1)))
    assert not s.upsert("a", grams(("x", "ab"), ("x", "bc"), ("y", "ab")), n(("x", 2), ("y", 1)))
    assert s.upsert("b", grams(("x", "cd"), ("z", "ab"), ("z", "bc")), n(("x", 3), ("z", 1)))
    early = s.read()
    # a writer that died before its marker
    (tmp_path / "s" / "version=3" / "grams").mkdir(parents=True)
    (tmp_path / "s" / "version=3" / "grams" / "part-0.parquet").write_bytes(b"broken")
    assert s.version() == 2
    s.record("c", spark.createDataFrame([("x", "PASSED"), ("x", "FAILED"), ("x", "ALL_PASSED"), ("y", "CONFLICTED")], "domain string, verdict string"))
    assert early["grams"].count() == 6  # readers of the version before may go on
    assert {tuple(r) for r in s.domains().collect()} == {("x", 5, 3, 0.005, 3, 0.667), ("y", 1, 1, 0.01, 1, 0.0), ("z", 1, 2, 0.01, 0, 0.0)}
    assert [(r.a, r.b, round(r.likeness, 3)) for r in s.suggest().orderBy("a", "b").collect()] == [("x", "z", 0.667), ("y", "z", 0.5)]
    pairs = lambda *r: spark.createDataFrame(list(r), "source string, target string")
    for wrong in (pairs(("x", "unknown")), pairs(("x", "y"), ("y", "z"))):
        with pytest.raises(KeyError):
            s.merge("wrong", wrong)
    assert s.merge("d", pairs(("x", "z"))) and not s.merge("d", pairs(("x", "z")))
    assert {tuple(r)[:3] for r in s.domains().collect()} == {("y", 1, 1), ("z", 6, 3)}
    texts = spark.createDataFrame([(1, "ab"), (1, "zz"), (2, "zz"), (3, "cd")], "id long, gram string")
    assert {tuple(r) for r in s.classify(texts, "id").collect()} == {(1, "y", 0.5), (1, "z", 0.5), (3, "z", 1.0)}
    assert s.remove("e", ["z"]) and [r.domain for r in s.domains().collect()] == ["y"]


def test_centroids_are_the_same_for_any_split(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], (rng.normal(0, 1, 5) * 10.0 ** rng.integers(-6, 6)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>")
    means = []
    for name, batches in (("one", ["true"]), ("two", ["id < 11", "id >= 11"]), ("back", ["id >= 40", "id < 40 and id % 3 = 0", "id < 40 and id % 3 > 0"])):
        s = store.Centroids(spark, str(tmp_path / name))
        for i, b in enumerate(batches):
            assert s.add(str(i), df.where(b), "c", "v")
            assert not s.add(str(i), df.where(b), "c", "v")
        means.append(sorted((r["class"], r.n, tuple(r.centroid)) for r in s.means().collect()))
    assert means[0] == means[1] == means[2]
    assert means[0][0][2] == pytest.approx(np.mean([v for _, c, v in rows if c == "a"], axis=0).tolist(), abs=1e-9)


# ---- rules that feed themselves ----


def test_rule_store_admits_once_and_retries_once(spark, tmp_path):
    sources = spark.createDataFrame([("甲方不得转让设备。乙方应当提供质量保修书。",), ("甲方不得转让设备。",), (None,)], "text string")
    samples = spark.createDataFrame([(1, "甲方不得转让设备，乙方提供质量保修书。", "PASSED"), (2, "无关的文字。", "FAILED")], "sample_id long, text string, expected string")
    s = bootstrap.RuleStore(spark, str(tmp_path / "r"))
    rounds = s.feed(sources, samples, [])
    rules = s.read()["rules"].collect()
    assert rules and len({r.key for r in rules}) == len(rules) and len(rounds) <= 2
    assert all(r.accepted == (not r.failed) for r in rules) and any(r.failed for r in rules)
    assert all(sum(x.subject == r.subject and x.retry for x in rules) <= sum(x.subject == r.subject and not x.retry for x in rules) for r in rules)
    version = s.version()
    assert s.feed(sources, samples, []) == [] and s.version() == version
    assert {r.condition_type for r in s.package()} <= {"forbidden_pattern", "required_pattern", "co_occurrence", "mutual_exclusion", "numeric_comparison"}
    more = sources.unionByName(spark.createDataFrame([("保修期限不得低于5年。",)], "text string"))
    s.feed(more, samples, [])
    assert s.version() > version and s.read()["sources"].count() == 4


def test_extracted_values_take_the_longest_label(spark):
    from lexmill.operators.rules import Rule

    rule = lambda i, label, unit: Rule(i, "numeric_comparison", {"label": label, "context_pattern": label, "operator": ">=", "expected": 2, "unit": unit, "legal_ref": ""})
    docs = spark.createDataFrame([(1, "屋面保修期限不得低于5年。"), (2, ""), (3, None)], "doc_id long, text string")
    got = bootstrap.extracted_values(docs, [rule("a", "保修期限", "年"), rule("b", "屋面保修期限", "年"), rule("c", "屋面", "%")]).collect()
    assert [(r.doc_id, r.rule_id, r.value, r.unit) for r in got] == [(1, "b", 5.0, "年")]


def test_values_in_the_row_are_those_of_joins(spark, sf_dir):
    from tests.test_plain import STATED

    texts = ["".join(s for _, s, *_ in STATED), "", None, "no hints", "保修期限为\n5\r年。保修期限为3年。 违约金不得超过十%；", "保修期限为零年。屋面保修期限不得低于5年。", "屋面保修期限 不少于 5年\u2028。"]
    texts += [s for _, s, *_ in STATED] + [f"保修期限为{i}年。违约金不得超过{30 - i}%。" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = [LQ.WARRANTY, LQ.PENALTY, Rule("z", "numeric_comparison", {"label": "屋面保修期限", "context_pattern": "屋面", "operator": "<=", "expected": 4, "unit": "年"}), Rule("a", "numeric_comparison", {"label": "期限", "context_pattern": "期限", "operator": ">=", "expected": 4})]
    evidence, fields = bootstrap.validate_with_extraction(docs, rules)
    want = evidence.join(fields, ["doc_id", "rule_id"], "left")
    got = bootstrap.validate_rows_with_extraction(docs, rules)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert fields.count() > 60
    plan = bootstrap.validate_rows_with_extraction(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan  # nothing is shuffled


def test_equal_texts_and_sentences_are_looked_at_once():
    from lexmill.functions.batches import each_once

    asked = []
    got = each_once(pa.array(["b", None, "a", "b", "", "a"]).slice(1), lambda v: asked.append(v) or ([v, v] if v else []), pa.list_(pa.string()))
    assert got.to_pylist() == [[], ["a", "a"], ["b", "b"], [], ["a", "a"]]
    assert sorted(asked) == ["", "a", "b"]
    assert each_once(pa.array([], pa.string()), str, pa.string()).to_pylist() == []


def test_templates_are_tried_only_where_their_words_are():
    """Each template finds the same with its words looked for first as without, in sentences made of all templates' parts."""
    rng = np.random.default_rng(4)
    parts = sorted({w for _, *_, p in extraction.TEMPLATES for w in re.findall("[一-鿿]+", p)}) + ["3年", "三十日", "5%", "，", "、", "甲方", "工程款", "2个工作日内"]
    always, found, skipped = re.compile(""), 0, 0
    for _ in range(1000):
        sentence = "".join(rng.choice(parts, rng.integers(1, 9)))
        for t in extraction._COMPILED:
            want = extraction.candidates_in(sentence, [(*t[:5], always)])
            assert extraction.candidates_in(sentence, [t]) == want
            found, skipped = found + len(want), skipped + (not t[5].search(sentence))
    assert found > 500 and skipped > 500


# ---- spans ----


def test_touching_spans_are_those_of_all_comparisons(spark):
    rng = np.random.default_rng(5)
    make = lambda n, most: [(int(d), int(s), int(s + w)) for d, s, w in zip(rng.integers(0, 4, n), rng.integers(0, 3000, n), rng.integers(0, most, n), strict=True)]
    spans, others = make(120, 900) + [(9, 0, 5), (0, 100, 100)], make(40, 60) + [(0, 512, 1024), (9, 5, 9)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, start long, end long")
    want = sorted(s for s in spans if any(s[0] == o[0] and s[1] < o[2] and o[1] < s[2] for o in others))
    for bucket in (1, 64, 512):
        assert sorted(map(tuple, intervals.touching(df(spans), df(others), "doc_id", bucket).collect())) == want
    assert sorted(map(tuple, intervals.uncovered(df(spans), df(others), "doc_id").collect())) == sorted(s for s in spans if s not in want)


def test_line_spans(spark):
    texts = {1: "a\n\n é日 \nlast", 2: "", 3: None, 4: "\n" * 700 + "x", 5: "one"}
    got = spark.createDataFrame(list(texts.items()), "id long, t string").select("id", F.explode(intervals.line_spans(F.col("t"))).alias("s")).collect()
    for r in got:
        assert texts[r.id][r.s.start : r.s.end] == r.s.line
    assert Counter(r.id for r in got) == {1: 3, 4: 1, 5: 1}


def test_regression_of_findings(spark):
    nodes = [(["a"], 0.1, 0.3), (["a", "x"], 0.5, 0.1), (["x"], 0.1, 0.6), (["x"], 0.9, 0.1), (["a"], 0.1, 0.2), ([], 0.9, 0.9)]
    df = spark.createDataFrame(nodes, "terms array<string>, confidence double, cross_confidence double")
    got = intervals.regression(df, spark.createDataFrame([("a",), ("a",), ("b",)], "term string")).collect()
    assert sorted(((tuple(r.terms), r.cross_confidence, r.action, r.target) for r in got), key=repr) == sorted([(("a",), 0.3, "correct_rule", "a"), (("a", "x"), 0.1, "upgrade_to_conjecture", None), (("x",), 0.6, "new_rule", None), (("x",), 0.1, "keep_outer", None), (("a",), 0.2, "keep_outer", None), ((), 0.9, "new_rule", None)], key=repr)


def test_spans_are_marked_once_and_the_first_pairs_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    spans = spark.createDataFrame([(1, 0, 5), (1, 6, 9), (2, 0, 3), (None, 0, 3)], "doc_id long, start long, end long")
    evidence = spark.createDataFrame([(1, 4, 7), (1, 4, 6), (2, 3, 4), (None, 0, 3)], "doc_id long, start long, end long")
    assert sorted(((r.doc_id, r.start, r.covered) for r in intervals.marked(spans, evidence, "doc_id").collect()), key=repr) == sorted([(1, 0, True), (1, 6, True), (2, 0, False), (None, 0, False)], key=repr)

    words = [[f"w{x}" for x in rng.integers(0, 40, n)] for n in rng.integers(0, 14, 200)]
    only = {"w3", "w17"}
    outer = spark.createDataFrame(list(enumerate(words)), "start long, terms array<string>")
    lone = spark.createDataFrame([(w,) for w in only] * 2, "term string")
    pairs = [next(([w[i], w[j]] for i in range(len(w)) for j in range(i + 1, min(len(w), i + 5)) if {w[i], w[j]} & only), None) for w in words]
    want = sorted(p for p in pairs if p)
    for most in (intervals.HOT, 1):
        monkeypatch.setattr(intervals, "HOT", most)
        assert sorted(r.terms for r in intervals.outer_pairs(outer, lone, ["start"]).collect()) == want


def test_terms_that_overlap_themselves_are_not_looked_for_at_each_character(spark):
    texts = ["", " de ", " de de  de", "x de de de ", "aaaa", "é😀aa aXa", None, " d e "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in (" de ", "aa", "aXa"):
        found = df.select(text.positions(F.col("t"), term).alias("p"))
        assert [r.p for r in found.collect()] == [[i for i in range(len(t or "")) if (t or "").startswith(term, i)] for t in texts]
        assert "UTF-32" not in found._jdf.queryExecution().analyzed().toString()


# ---- constraints with quantifiers ----


def test_quantified_constraints(spark):
    a = spark.createDataFrame([(1, "x", 5.0), (2, "x", 1.0), (3, "y", 1.0), (4, "x", None)], "id long, kind string, v double")
    b = spark.createDataFrame([(10, 1, 7.0), (11, 2, 9.0), (12, 2, None)], "bid long, owner long, w double")
    things, parts = quantified.Sort(a, "id"), quantified.Sort(b, "bid")
    big = quantified.numeric("big", things, a.kind == "x", a.v, ">=", 2.0)
    small_parts = quantified.ForAll("small parts", things, a.kind == "x", b.w < 8, parts, {"id": "owner"})
    has_part = quantified.Exists("has a part", things, a.kind == "x", b.w > 0, parts, {"id": "owner"})
    rows = lambda c: sorted((r.subject, r.witness) for r in quantified.violations(c).collect())
    assert rows(big) == [("2", None)] and rows(small_parts) == [("2", "11")] and rows(has_part) == [("4", None)]
    got = {r.constraint: (r.holds, r.broken_by, r.subject, r.witness) for r in quantified.check([big, small_parts, has_part, quantified.numeric("y", things, a.kind == "y", a.v, "==", 1.0)]).collect()}
    assert got == {"big": (False, 1, "2", None), "small parts": (False, 1, "2", "11"), "has a part": (False, 1, "4", None), "y": (True, 0, None, None)}
    assert not quantified.proved(big) and quantified.proved(quantified.numeric("z", things, a.kind == "z", a.v, ">", 0.0))


# ---- a classifier that is kept ----


def test_tfidf_is_the_plain_formula_after_reload(spark, tmp_path):
    texts = [(1, "aa", "the cat  sat"), (2, "aa", "The dog"), (3, "bb", "der hund"), (4, "bb", ""), (5, "bb", None), (6, None, "left out"), (7, "aa", "the")]
    tfidf.train(spark.createDataFrame(texts, "id long, c string, text string"), "id", "c").save(str(tmp_path / "m"))
    asked = [(1, "the hund"), (2, ""), (3, None), (4, "日本"), (5, "sat  on")]
    model = tfidf.TfIdfModel.load(spark, str(tmp_path / "m"))
    asked_df = spark.createDataFrame(asked, "id long, text string")
    got = {(r.id, r["class"]): r.probability for r in tfidf.probabilities(model, asked_df, "id").collect()}

    def grams(t):
        import re

        t = re.sub(r"\s\s+", " ", (t or "").lower())
        return Counter(t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1))

    known = [(c, grams(t)) for _, c, t in texts if c]
    df = Counter(g for _, gs in known for g in gs)
    idf = {g: math.log((1 + len(known)) / (1 + k)) + 1 for g, k in df.items() if k <= 0.95 * len(known)}

    def vector(gs):
        v = {g: (1 + math.log(n)) * idf[g] for g, n in gs.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / norm for g, x in v.items()}

    sums, size = defaultdict(Counter), Counter(c for c, _ in known)
    for c, gs in known:
        for g, x in vector(gs).items():
            sums[c][g] += x
    for i, t in asked:
        v = vector(grams(t))
        s = {c: math.log(size[c] / len(known)) + sum(x * math.log((sums[c][g] + 1) / (sum(sums[c].values()) + len(idf))) for g, x in v.items()) for c in size}
        total = sum(math.exp(x) for x in s.values())
        for c in s:
            assert got[i, c] == pytest.approx(math.exp(s[c]) / total, abs=1e-9)
    best = {r.id: (r["class"], r.source) for r in tfidf.with_fallback(tfidf.predict(model, asked_df, "id"), spark.createDataFrame([(2, "cc"), (3, None)], "id long, class string"), "id", 0.99).collect()}
    assert best[2] == ("cc", "fallback") and best[3][1] == "model" and best[4][1] == "model"


def test_ngrams_are_counted_in_one_row_of_a_text_and_rare_ones_joined_apart(spark, monkeypatch):
    texts = [(1, "aa", "the cat  sat"), (2, "aa", "The dog \U0001f600\0"), (3, "bb", "der hund"), (4, "bb", ""), (5, "bb", None), (5, "bb", "und  so"), (6, "bb", "hund")]
    df = spark.createDataFrame(texts, "id long, c string, text string")
    got = tfidf.counted(df.where("id < 4"), "id")
    assert got.count() == 3 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    spelled = {(r.id, r.gram): r.n for r in tfidf._each(tfidf.counted(df, "id"), "id").select("id", tfidf.spelled(F.col("gram")).alias("gram"), "n").collect()}
    want = Counter((i, s[a : a + k]) for i, _, t in texts for s in [(t or "").lower().replace("  ", " ")] for k in (1, 2, 3) for a in range(len(s) - k + 1))
    assert spelled == want
    grams = spark.createDataFrame([(g,) for g in {g for _, g in want}], "gram string").select("gram", tfidf.numbered(F.col("gram")).alias("n"))
    assert all(r.gram == r.back for r in grams.select("gram", tfidf.spelled(F.col("n")).alias("back")).collect()) and grams.select("n").distinct().count() == grams.count()

    def told():
        model = tfidf.train(df, "id", "c")
        return {(r.id, r["class"]): r.probability for r in tfidf.probabilities(model, df.select("id", "text").where("id <> 5"), "id").collect()}

    whole = told()
    for most in (12, 60):
        monkeypatch.setattr(tfidf, "HOT", most)
        assert told() == pytest.approx(whole, abs=1e-12)
