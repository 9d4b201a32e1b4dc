"""Queries that SQL can't express, against plain versions over whole tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import clauses as C
from lexmill.operators import extraction as X
from lexmill.operators import profiles as P
from lexmill.plans import registry
from lexmill.sources import domains as D


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()


def clusters_by_hand(ids, v, eps, least):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.maximum(1 - unit @ unit.T, 0) <= eps
    np.fill_diagonal(near, False)
    core = near.sum(axis=1) >= least
    label = np.full(len(ids), -1)
    for start in np.argsort(ids):
        if core[start] and label[start] < 0:
            todo = [start]
            while todo:
                i = todo.pop()
                if label[i] < 0:
                    label[i] = ids[start]
                    todo += [j for j in np.flatnonzero(near[i]) if core[j] and label[j] < 0]
    out = {}
    for i in range(len(ids)):
        own = label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i]) if core[j]), default=-1)
        out[ids[i]] = own
    return out if any(c >= 0 for c in out.values()) else dict.fromkeys(out, 0)


def test_clusters(spark, sf_dir, vectors):
    from lexmill.operators.clusters import dbscan

    ids, v = vectors.vec_id.to_numpy(), np.stack(vectors.embedding.to_numpy()).astype(float)
    got = {r.vec_id: r.cluster for r in registry.queries()["dbscan_clusters"](spark, sf_dir).collect()}
    assert got == clusters_by_hand(ids, v, 0.35, 2)
    # and vectors that are dense enough to have clusters across their labels, noise and borders
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=8) + rng.normal(size=(40, 8)) * s for s in (0.15, 0.3, 0.5, 1.0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for eps, least in ((0.02, 2), (0.1, 3), (0.35, 5)):
        want = clusters_by_hand(np.arange(len(v)), v, eps, least)
        assert {r.vec_id: r.cluster for r in dbscan(df, "vec_id", "embedding", eps, least).collect()} == want


def test_distances_to_prototypes(spark, sf_dir, vectors):
    from lexmill.operators import classify as K

    def by_hand(ids, labels, v):
        out = {}
        for c in set(labels):
            own = v[labels == c]
            cov = np.cov(own.T) if len(own) > 1 else np.eye(v.shape[1])
            inverse = np.linalg.inv(cov) if np.linalg.matrix_rank(cov) == len(cov) else np.eye(len(cov))
            diff = own - own.mean(axis=0)
            out |= dict(zip(ids[labels == c], np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", diff, inverse, diff), 0)), strict=True))
        return out

    ids, labels, v = vectors.vec_id.to_numpy(), vectors.label.to_numpy(), np.stack(vectors.embedding.to_numpy()).astype(float)
    got = {r.vec_id: r.distance for r in registry.queries()["mahalanobis_distance"](spark, sf_dir).collect()}
    assert got == pytest.approx(by_hand(ids, labels, v), rel=1e-6)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) + 10
    labels = np.arange(90) % 3
    df = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(labels, v, strict=True))], "vec_id long, label long, v array<double>")
    found = K.mahalanobis_distances(df, K.mahalanobis_prototypes(df, "label", "v"), "label", "v")
    assert {r.vec_id: r.distance for r in found.collect()} == pytest.approx(by_hand(np.arange(90), labels, v), rel=1e-6)


def scanned_by_hand(text):
    """Every pattern on the whole text; a match is left out if it starts within five characters of any earlier one's span."""
    spans, out = [], []
    for kind, severity, pattern in X.SCAN:
        for m in re.finditer(pattern, text, re.IGNORECASE | re.MULTILINE):
            if any(a - 5 <= m.start() <= b + 5 for a, b in spans):
                continue
            spans.append(m.span())
            terms = []
            for piece in [p for g in m.groups() if g for p in re.split("[和与、且,;，；]", g.strip("，,；;。. "))]:
                term, before = piece.strip(" '\"（(）)。."), None
                while term != before and len(term) >= 2:
                    before = term
                    fits = [w for w in X.LEADING if term.startswith(w) and term != w]
                    term = term[max(map(len, fits)) :].strip() if fits else term
                terms += [term] * (len(term) >= 2)
            if terms:
                out.append((kind, severity, terms, m.group(0).strip()[:200]))
    return out


SENTENCES = [
    "甲方和乙方不得同时担任监理。不得同时使用水泥和石灰。", "如果逾期付款，则应当支付违约金。若未约定，必须载明。", "由于甲方与乙方协商一致，因此本合同生效。", "合同必须包含保修条款；严禁转包。禁止",
    "The parties cannot both sign and seal. If it rains, then must include a cover.", "Because of wind and rain, therefore work stops\nThe report must include a summary, must state it", "You shall not copy it; may not sell. PROHIBITED acts", "当事人应当\n提供证明。不得出现A、B", "", "无",
]


def test_scanner(spark, sf_dir):
    assert {k for t in SENTENCES for k, *_ in scanned_by_hand(t)} == {k for k, *_ in X.SCAN}
    for t in [*SENTENCES, "".join(SENTENCES), "\n".join(SENTENCES * 3)]:
        assert X.rules_in(t) == scanned_by_hand(t), t
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r.doc_id, i, k, s, "|".join(t), src) for r in rows for i, (k, s, t, src) in enumerate(scanned_by_hand(r.text)))
    got = registry.queries()["keyword_scan"](spark, sf_dir).where("doc_id >= 0").collect()
    assert sorted(tuple(r) for r in got) == want


def chapters_by_hand(text):
    lines = text.splitlines()
    heads = [(i, *C.heading(x)) for i, x in enumerate(lines) if C.heading(x)]
    out = []
    if len(heads) > 1:
        for n, (at, title, level) in enumerate(heads):
            end = next((i for i, _, below in heads[n + 1 :] if below <= level), len(lines))
            out.append((n, title, level, "\n".join(x for x in lines[at + 1 : end] if x.strip()).strip()))
    else:
        blocks = [b.strip() for b in re.split(r"\n\s*\n", text) if len(b.strip()) >= 50]
        for n, b in enumerate(blocks):
            one = "\n" not in b and len(b.splitlines()) == 1
            out.append((n, "" if one else b.splitlines()[0].strip().rstrip("。；;.,"), 1, b if one else "\n".join(b.splitlines()[1:]).strip()))
    return [c for c in out if len(c[3]) >= 50]


def test_headings_and_chapters(spark, sf_dir):
    for line, want in [
        ("第三章 保修", ("保修", 1)), ("第2节", ("第2节", 1)), ("十二、付款", ("付款", 1)), ("1 Scope", ("Scope", 1)), ("1.2 Terms", ("Terms", 2)), ("1.2.3. Deep", ("Deep", 3)), ("IV. Results", ("Results", 1)),
        ("总则", ("总则", 1)), ("GENERAL TERMS", ("GENERAL TERMS", 1)), ("###### six", ("six", 6)), ("####### seven", None), ("第5条 甲方", None), ("plain text", None), ("# " + "x" * 119, None), ("   ", None),
    ]:
        assert C.heading(line) == want, line
    body = "some words of a body " * 4
    texts = ["", "no heading", f"# a\n{body}\n\n## b\n{body}\n### c\n{body}\n## d\n{body}\n# e\n{body}", f"Title.\n{body}\n\n{body}\n\nshort", "\n".join(f"{i} Head\n{body}" for i in range(70)), f"I. one\n{body}\nII. two\nshort"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {}
    for r in C.chapters(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.chapter_ix, r.title, r.level, r.body))
    assert got == {i: c for i, t in enumerate(texts) if (c := chapters_by_hand(t))}
    assert len(got[4]) == 70 and C.chapters_of(texts[4], most=60) == got[4][:60]


def test_directions(spark):
    words = {"shows": 1, "REDUCES cost": -1, "is not": 1, "works": 1, "no effect": -1, "harmful": -1, "meaningful": 1, "non-significant": 1, "harms": -1, "relates to": 0, " ": 0}
    rows = spark.createDataFrame(list(words.items()), "p string, want int")
    got = {r.p: r.d for r in rows.select("p", P.direction(rows.p).alias("d")).collect()}
    assert got == words


def test_layers_meet_at_lengths(spark, tmp_path):
    """At each length where a layer begins, with and without keywords; exactly 1,600 characters is where the term set's words change."""
    import duckdb

    lengths = [500, 501, 1000, 1499, 1500, 1599, 1600, 1601, 3000, 3001, 5000, 5001]
    rows = [(i, (w + "x" * n)[:n], "de", "web", n) for i, (n, w) in enumerate((n, w) for n in lengths for w in ("the and ", "les ", ""))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["layered_domain"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["layered_domain"]).fetchall())
    # by itself, a term set that says that it knows none gives no answer
    none, sure = F.lit(None).cast("string"), F.lit(0.5)
    layer = P.layered_domain(none, none, F.lit("未知"), sure, none.cast("double"), none, none, F.lit("k"))
    assert spark.range(1).select(layer.alias("l")).first().l.source == "keyword"


def test_a_domain_that_was_written_is_found(spark, tmp_path):
    D.write_domain(spark, str(tmp_path / "mine"), {"id": "mine", "name": "n", "version": "1", "files": {"rules": "rules.json"}}, [{"id": "r1", "condition": {"type": "required_pattern", "terms": ["保修"]}}], {"g": ["a", "b"]})
    found = D.resolve(D.discover(spark, str(tmp_path)), "mine").first()
    assert found.name == "n" and found.path.endswith("/mine")
    assert [(r.id, r.params) for r in D.load_rules(spark, f"{found.path}/{found.files['rules']}")] == [("r1", {"terms": ["保修"]})]
    assert [tuple(r) for r in D.load_ontology(spark, f"{found.path}/ontology.json").orderBy("gpos").collect()] == [("g", 0, "a"), ("g", 1, "b")]


STATED = [
    (0, "屋面工程的保修期限最低不少于5年。", "屋面工程", 5.0, "年", []), (1, "质保金不超过3%。", "质保金", 3.0, "%", []), (2, "保修期限不得低于2年。", "保修期限", 2.0, "年", []),
    (3, "违约金不应超过十天。", "违约金", 10.0, "天", []), (4, "工期，为90天。", "工期", 90.0, "天", []), (5, "屋面防水工程、外墙面的防渗漏，为5年。", "屋面防水工程、外墙", 5.0, "年", []),
    (6, "期限应当不少于三个月。", "期限", 3.0, "月", []), (7, "合同应当明确保修责任和期限。", "合同", None, None, ["保修责任", "期限"]), (8, "施工单位必须有资质证书。", "施工单位必", None, None, ["资质证书"]),
    (9, "禁止转包。", "转包", None, None, ["转包"]), (9, "禁止违法转包。", "违法转包", None, None, ["违法转包"]), (10, "发包人不得指定分包单位。", "发包人", None, None, ["指定分包单位"]),
    (11, "承包人不得同时担任监理和设计。", "承包人", None, None, ["担任监理", "设计"]), (12, "甲方和乙方不得同时中标。", "甲方", None, None, []), (13, "验收记录应当与设计文件一致。", "验收记录", None, None, ["设计文件"]),
    (14, "2年。", None, None, None, None), (14, "质量缺陷 2年。", "质量缺陷", 2.0, "年", []), (15, "出卖人应当交付标的物。", "出卖人", None, None, ["标的物"]), (16, "买受人有权解除合同。", "买受人", None, None, ["解除合同"]),
    (17, "本工程严禁转包。", "本工程", None, None, ["转包"]), (18, "承包人负责现场管理。", "承包人", None, None, ["现场管理"]), (19, "自验收合格之日起计算。", "验收合格之日", None, None, ["计算"]),
    (20, "双方按照约定履行义务。", "双方", None, None, ["履行义务"]), (21, "质量要求不明确的按照标准履行。", "质量要求", None, None, ["的按照标准履行"]), (22, "债权人取得留置权后通知。", "债权人取得", None, None, ["后通知"]),
    (23, "预付款、进度款合计不得超过合同总价的105%。", "预付款、进度款", 105.0, "%", []), (24, "工程验收合格后30日内付款。", "工程", 30.0, "日内", []), (24, "验收后30日内付款。", None, None, None, None),
    (25, "发包人三十日内支付工程款。", "发包人", 30.0, "日内", []),
]


def test_each_sentence_template(spark):
    assert {t for t, *_ in STATED} == set(range(len(X.TEMPLATES)))
    for template, sentence, subject, expected, unit, terms in STATED:
        found = X.candidates_in(sentence, X._COMPILED[template : template + 1])
        # without terms: a match that has neither a subject nor words before it is left out
        assert found == [] if terms is None else [(c[1], c[3], c[4], c[5]) for c in found] == [(subject, expected, unit, terms)], (template, found)
    texts = [(i, s) for i, (_, s, *_) in enumerate(STATED)]
    got = {}
    for r in X.extract_rules(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert (r.doc_id, r.subject, r.condition_type) not in got
        got[r.doc_id, r.subject, r.condition_type] = r.confidence
    best = {}
    for i, s in texts:
        for c in X.candidates_in(s):
            best[i, c[1], c[0]] = max(best.get((i, c[1], c[0]), 0), c[6])
    assert got == best


def test_candidates_are_told_by_their_words(spark):
    schema = "doc_id long, condition_type string, subject string, source_text string"
    rows = [(1, "numeric_comparison", "屋面防水工程", "屋面防水工程的保修期限为5年"), (2, "required_pattern", "甲方", "甲方应当通知乙方"), (3, "forbidden_pattern", "承包人的某些义务说明", None), (4, "forbidden_pattern", "转包", "禁止转包")]
    got = {r.doc_id: (r.context_pattern, r.clause_type, r.legal_ref, r.severity) for r in X.as_candidates(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("屋面防水|保修|防水|期限", "保修", "国务院令第279号", "major")
    assert got[2] == ("甲方", "其他", X.NO_REF, "warning") and got[3] == ("承包人的某些义务说明", "其他", X.NO_REF, "warning")
    assert got[4] == ("转包", "工程管理", X.NO_REF, "warning")


def test_modal_rules(spark, sf_dir):
    assert X.modal_rules_in("发包人不得指定分包，单位") == [("forbidden_pattern", "发包人不得指定分", "")]  # words of eight characters at most
    assert X.modal_rules_in("合同，承包人必须质量，保证") == [("co_occurrence", "承包人", "质量")]
    assert X.modal_rules_in("应当") == [] and X.modal_rules_in("不得") == [("forbidden_pattern", "不得", "")]
    assert len(X.modal_rules_in("甲方不得转让\n" * 80)) == 80 and len(X.modal_rules_in("甲方不得转让\n" * 80, 50)) == 50
    assert registry.queries()["modal_rules"](spark, sf_dir).where("doc_id < 0").count() > 0


def test_units_of_documents(spark, sf_dir):
    law = "前言\n第一章 总则\n第一条 甲。\n第二条 乙。\n第二章 附则\n无条"
    assert C.units_of(law) == [("第一章总则", 1, "第一条 甲。\n第二条 乙。", ""), ("第一条", 2, "甲。", "第一章总则"), ("第二条", 2, "乙。", "第一章总则"), ("第二章附则", 1, "无条", "")]
    assert C.units_of("intro\n1. One\nbody\n2、Two\n") == [("1. One", 1, "body", ""), ("2、Two", 1, "", "")]
    assert C.units_of(" flat ") == [("全文", 0, "flat", "")] and C.units_of("") == [("全文", 0, "", "")]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = sum(max(1, len(re.findall(r"(?m)^\d+[.、]\s*.+$", t))) for t in texts.values())
    assert registry.queries()["document_units"](spark, sf_dir).count() == want


def test_hybrid_distance_with_sparse_n_grams(spark):
    from lexmill.operators.classify import hybrid_distance

    rows = [(1, [1.0] * 10, [1.0] * 10, {"a": 1.0}, {"a": 2.0}, 0.0), (2, [1.0] * 10, [1.0] * 10, {"a": 1.0}, {"b": 2.0}, 0.5), (3, [1.0] * 6 + [0.0] * 4, [1.0] * 6 + [0.0] * 4, {}, {"b": 2.0}, 0.2), (4, [0.0] * 10, [1.0] * 10, {}, {}, 1.0)]
    df = spark.createDataFrame(rows, "i long, a array<double>, b array<double>, x map<string,double>, y map<string,double>, want double")
    for r in df.select("want", hybrid_distance(df.a, df.b, df.x, df.y).alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-12)


def test_synonyms(spark, sf_dir):
    from collections import Counter, defaultdict

    from lexmill.plans.profile_queries import SYNONYM_RULES

    words = lambda t: {w for w in re.split("[^a-z]+", t) if len(w) >= 2}
    blocks = [(r.doc_id, r.lang, line.lower()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for line in r.text.split("\n") if line.strip(" ")]
    want = {}
    for rule, terms in SYNONYM_RULES.items():
        holds = [any(t in text for t in terms) for _, _, text in blocks]
        target = {lang for (_, lang, _), h in zip(blocks, holds, strict=True) if h}
        o11, o21, free, seen = Counter(), Counter(), Counter(), defaultdict(set)
        m = sum(lang not in target for _, lang, _ in blocks)
        for (doc, lang, text), h in zip(blocks, holds, strict=True):
            if h:
                at = [(text.find(t), text.find(t) + len(t)) for t in terms if t in text]
                for w in words(text[max(0, min(a for a, _ in at) - 50) : max(b for _, b in at) + 50]):
                    o11[w] += 1
                    seen[w].add(doc)
            for w in words(text):
                o21[w] += lang not in target
                free[w] += lang in target and not h
        n1 = sum(holds)
        for w, a in o11.items():
            if a < 3 or len(seen[w]) < 3 or m < 3 or n1 < 3:
                continue
            b, c, d = n1 - a, o21[w], m - o21[w]
            n = a + b + c + d
            low = (a + b) * (c + d) * (a + c) * (b + d)
            chi2 = n * max(0, abs(a * d - b * c) - n / 2) ** 2 / low if low else 0
            if a / n1 > c / m and chi2 >= 3.84:
                tier = "AUTO" if chi2 >= 10 and free[w] >= 3 and len(seen[w]) >= 5 else "REVIEW" if chi2 >= 6.63 and free[w] >= 2 else "SUGGEST"
                want[rule, w] = (chi2, free[w], tier)
    got = {(r.rule_id, r.gram): (r.chi2, r.substitutable, r.tier) for r in registry.queries()["synonym_discovery"](spark, sf_dir).collect()}
    assert want and got.keys() == want.keys()
    for k, (chi2, free_, tier) in want.items():
        assert got[k][0] == pytest.approx(chi2, abs=1e-3) and got[k][1:] == (free_, tier), k


def test_gram_hashes_and_counts(spark):
    from collections import Counter

    from lexmill.functions import text as T

    def by_hand(g):
        h = 0
        for c in g:
            h = (h * 31 + ord(c)) & 0x7FFFFFFF
        return h ^ 0x80000000 if len(g) == 3 else h

    grams = ["ab", "保修", "保修期", "😀x", "", "a", "屋面防水工程"]
    rows = spark.createDataFrame([(g,) for g in grams], "g string")
    assert [r.h for r in rows.select(T.gram_hash(rows.g).alias("h")).collect()] == [by_hand(g) for g in grams]
    text = "保修期，保修期限abc保修。修"
    got = spark.createDataFrame([(text,)], "t string").select(T.gram_counts(F.col("t"), 2).alias("c")).first().c
    han = re.sub("[^一-鿿]", "", text)
    assert {r.gram: r.n for r in got} == Counter(han[i : i + 2] for i in range(len(han) - 1))


def test_depths_of_a_taxonomy(spark):
    from lexmill.operators.ontology import taxonomy_depths

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {r.concept: (r.depth, r.descendants) for r in taxonomy_depths(edges).collect()}
    assert got == {"a": (2, 0), "b": (1, 1), "c": (0, 3), "d": (1, 0), "x": (1, 1), "y": (1, 1)}


def test_packages_of_a_session(spark, tmp_path):
    from lexmill.operators.rules import Rule

    held = D.Packages()
    held.load("a", [Rule("r1", "required_pattern", {"pattern": "a|b"})])
    held.load("b", [Rule("r2", "required_pattern"), Rule("r3", "required_pattern")])
    with pytest.raises(ValueError, match="already"):
        held.load("a", [])
    with pytest.raises(KeyError):
        held.reload("c", [])
    with pytest.raises(ValueError, match="r4: its pattern"):
        held.load("d", [Rule("r4", "forbidden_pattern", {"pattern": "("})])
    held.reload("a", [])
    held.unload("none")
    assert held.listed() == [("a", 0), ("b", 2)] and [r.id for r in held.rules()] == ["r2", "r3"]
    held.unload("b")
    assert held.listed() == [("a", 0)]

    for name in ("rules.json", "main-contract.json", "own.json"):
        (tmp_path / name).write_text("{}")
    files = lambda m: [f.rpartition("/")[2] for f in D.package_files(spark, str(tmp_path), m)]
    assert files({"rules_packages": ["own.json", "absent.json"]}) == ["own.json"] and files({"rules_packages": ["absent.json"], "rules_package": "own.json"}) == ["own.json"]
    assert files({}) == files({"rules_package": "absent.json"}) == ["rules.json", "main-contract.json"]
