"""Queries on ontologies, extraction, learning, questions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import remove, shared
from ..operators import clauses as C
from ..operators import extraction as X
from ..operators import learning as L
from ..operators import mining as M
from ..operators import ontology as O
from ..operators import questions as Q
from ..operators.graph import reliable
from ..streaming import validate as V
from .inline import frame, values
from .rule_queries import _EV, PACKAGE, docs, package_evidence

GROUPS = [("保修", 0, "保修"), ("保修", 1, "质保"), ("保修", 2, "Warranty"), ("付款", 0, "付款"), ("付款", 1, "支付"), ("争议", 0, "仲裁")]
RULE_TERMS = [("r1", 0, "质保"), ("r1", 1, "工期"), ("r2", 0, "支付"), ("r2", 1, "付款"), ("r3", 0, "WARRANTY")]
EXPANDED = [("r1", "质保,保修,Warranty,工期"), ("r2", "支付,付款"), ("r3", "WARRANTY,保修,质保")]
SURFACES = [("保修期", "warranty"), ("保修期限", "warranty_term"), ("付款", "payment"), ("期限", "term")]
FIELDS = [("保修期限",), ("屋面保修期限约定",), ("付款比例",), ("工期",), ("期限",)]
TAXONOMY = [("屋面防水", "防水工程"), ("防水工程", "工程"), ("工程", "标的"), ("装修", "工程")]


def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.expand_terms(frame(spark, RULE_TERMS, "rule_id string, pos long, term string"), frame(spark, GROUPS, "group string, gpos long, term string"))
    return out.select("rule_id", F.array_join("terms", ",").alias("terms"))


def field_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.canonical_field(frame(spark, FIELDS, "field string"), frame(spark, SURFACES, "surface string, canonical string"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are below regions, regions below the world: all ancestors and their distances."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    up = n.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(n.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))).distinct()
    return O.taxonomy_paths(up).withColumn("distance", F.col("distance").cast("long"))


def taxonomy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame(spark, [*TAXONOMY, ("甲", "乙"), ("乙", "甲")], "child string, parent string")
    return O.taxonomy_faults(e, frame(spark, [(c,) for c in ("屋面防水", "防水工程", "工程", "装修", "甲", "乙")], "concept string"))


def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of part names with one phrase."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.round(M.term_overlap(F.lit("part number 12"), F.col("p_name")), 6).alias("overlap"))


def whitelist_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frame(spark, [("保修期限",), ("保修",), ("屋面期限",), ("违约金额",), ("天气",)], "term string")
    return t.select("term", O.allowed_term(F.col("term"), ["保修期限", "违约金"]).alias("how"))


def origin_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, [(1, "保修期限不少于5年。", ["保修", "质保"], 5.0, 0.8), (2, "付款30天内。", ["付款"], 30.0, 0.8), (3, "付款30天内。", ["付款"], 45.0, 0.8)], "id long, source_text string, terms array<string>, value double, confidence double")
    return O.verified_extraction(rows).select("id", F.array_join("terms", ",").alias("terms"), "confidence")


LAW = [
    (1, "第四十条 屋面防水工程的保修期限，为5年。保修期限不得低于2年。承包人应当提供质量保修书。"),
    (2, "禁止转包。发包人不得指定分包单位。逾期违约金不超过合同总价的百分之五；工程款应当在30日内支付。"),
    (3, "没有规则的句子。"),
]


def template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.extract_rules(frame(spark, LAW, "doc_id long, text string"))
    return out.select("doc_id", "condition_type", "subject", "operator", "expected", "unit", F.array_join("terms", ",").alias("terms"), "confidence")


def keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that documents state, and some sentences of a law under negative ids."""
    law = frame(spark, [(-i, t) for i, t in LAW], "doc_id long, text string")
    out = X.scan_keywords(docs(spark, sf_dir).select("doc_id", "text").unionByName(law))
    return out.select("doc_id", F.col("ix").cast("long").alias("ix"), "condition_type", "severity", F.array_join("terms", "|").alias("terms"), "source_text")


def candidate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.as_candidates(X.extract_rules(frame(spark, LAW, "doc_id long, text string")))
    return out.select("doc_id", "condition_type", "subject", "context_pattern", "clause_type", "legal_ref", "severity")


def modal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = frame(spark, [(-i, t) for i, t in LAW], "doc_id long, text string")
    return X.modal_rules(docs(spark, sf_dir).select("doc_id", "text").unionByName(law))


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all documents: of their numbered headings, or each as a whole."""
    out = C.document_units(docs(spark, sf_dir))
    return out.select("doc_id", F.col("unit_ix").cast("long").alias("unit_ix"), F.sha2("title", 256).alias("title_sha256"), F.col("level").cast("long").alias("level"), F.sha2("body", 256).alias("body_sha256"))


def concept_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of the benchmark's items with definition contexts (of which there are none) and parents."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lower("text").alias("text"))
    return X.concepts(b, run_pattern=r"(?<![a-z])[a-z]{2,8}(?![a-z])", n=50).select("term", "freq", "score")


def three_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rules p3 and p4 of a package against its other rules; documents labelled as bad are negative samples."""
    ev = package_evidence(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), "rule_id", F.col("rule_ix").isin(2, 4).alias("is_candidate"), "status", F.sha2("input_fragment", 256).alias("fragment"))
    expected = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 0, "FAILED").otherwise("PASSED").alias("expected"))
    return X.gates(ev, expected).select("rule_id", "applicable", "negatives")


NUMERIC = [("cn-1", "保修期限", ">=", 5.0, "年"), ("cn-2", "违约金", "<=", 3.0, "%")]


def adversarial_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.variants(frame(spark, NUMERIC, "rule_id string, label string, operator string, expected double, unit string"))


def perturbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(X.perturbations(F.col("text"), {"the ": "that ", "und ": "oder "})).alias("v")).select("doc_id", "v.kind", F.length("v.text").cast("long").alias("n"))


def gold_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's verdicts against labels as expectations, by language and in all."""
    found = package_evidence(spark, sf_dir).where("rule_ix = 0").select("doc_id", "status")
    d = docs(spark, sf_dir).select("doc_id", "lang")
    expected = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("quality") == 0, "FAILED").otherwise("PASSED").alias("expected")).join(d, "doc_id")
    return L.score_summary(L.score(found, expected, ["doc_id"]), "lang").withColumn("accuracy", F.round("accuracy", 6))


def dual_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the verdicts of one rule differ from those of another, against labels."""
    e = package_evidence(spark, sf_dir)
    expected = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("quality") == 0, "FAILED").otherwise("PASSED").alias("expected"))
    a, b = (L.score(e.where(F.col("rule_ix") == ix).select("doc_id", "status"), expected, ["doc_id"]) for ix in (0, 3))
    return L.compare_paths(a, b, ["doc_id"]).groupBy("change").agg(F.count("*").alias("n"))


def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length thresholds for quality, by language: one descent each."""
    d = docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return L.tune_thresholds(d.select(F.col("lang").alias("rule_id"), F.lit(500.0).alias("start"), F.col("n_chars").cast("double").alias("value"), F.col("quality").alias("target")))


def soft_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft comparisons of order prices with a threshold, and their hinge loss."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = L.soft_compare(F.col("o_totalprice"), F.lit(150000.0), ">=", 20000.0)
    return o.select(F.col("o_orderkey"), F.round(s, 6).alias("score"), F.round(L.hinge(s, (F.col("o_orderstatus") == "F").cast("int")), 6).alias("loss"))


def nb_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of features moved by feedback from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    grams = e.groupBy("event_type").agg(F.count("*").alias("k")).select(F.lit("all").alias("class"), F.col("event_type").alias("gram"), F.log(F.col("k") / F.lit(1e6)).alias("log_prob"))
    feedback = e.where("value > 90").groupBy(F.lit("all").alias("class"), F.col("event_type").alias("gram")).agg(F.count("*").alias("n"))
    return L.shift_probabilities(grams, feedback, 0.0005).select("gram", (F.round("log_prob", 6) + 0.0).alias("log_prob"))


FACTS = [("保修期限", ">=", 5.0, "年"), ("付款期限", "<=", 30.0, "天"), ("违约金比例", "<=", 3.0, "%")]
KNOWN = Q.Knowledge(FACTS, {"缺陷责任期": "保修", "质保金": ""}, {"质保金": ["质量保证金", "保修金"]})
CONTRACT = {"保修期限": 3.0, "付款期限": 30.0, "违约金比例": 5.0}
#: Questions, the values of a contract that they are asked about, and the stated answers.
QUESTIONS = [
    (1, "保修期限最少几年？", None, "lookup", "保修期限 必须 >= 5.0 年"),
    (2, "如果保修期限改为3年会怎样？", None, "what_if", "保修期限 = 3.0: 违反 >= 5.0 年"),
    (3, "列出付款期限", None, "list", "未找到匹配的约束。"),
    (4, "缺陷责任期是什么", None, "definition", "缺陷责任期: 缺陷责任期，属于 保修"),
    (5, "合同是否合规？", CONTRACT, "compliance", "不合规：2 条违反。保修期限 (3.0 vs >= 5.0); 违约金比例 (5.0 vs <= 3.0)"),
    (6, "合同是否合规？", None, "compliance", "无法判定：未提供合同条款数据。"),
    (7, "合同符合规定吗", {"付款期限": 20.0}, "compliance", "合规：所有条款均满足法规要求。"),
    (8, "天气怎么样", None, "lookup", "未找到匹配的法规阈值。"),
    (9, "假如工期改为20天", None, "what_if", "未找到与 '工期' 匹配的法规约束。"),
    (10, "保修金的定义", None, "definition", "质保金: 质量保证金, 保修金"),
    (11, "list 期限, 比例", None, "list", "找到 3 条约束:\n1. 保修期限: >= 5.0 年\n2. 付款期限: <= 30.0 天\n3. 违约金比例: <= 3.0 %"),
    (12, "如果会怎样", None, "what_if", "无法解析 what-if 格式。"),
    (13, "什么是合同", None, "definition", "未找到该概念的定义。"),
]


def qa_numeric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to questions of all kinds."""
    asked = frame(spark, [q[:3] for q in QUESTIONS], "id long, question string, facts map<string,double>")
    return Q.answers(asked, KNOWN, facts_col="facts").select("id", "route", "answer")


def outer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur repeatedly in documents whose opening 200 characters don't have them."""
    s = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("sentence"))
    return M.outer_sentences(s, docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 200).alias("fragment"))).select(F.sha2("sentence", 256).alias("sentence_sha256"), "n")


def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of a package over a stream of the documents' file, counted."""
    base = docs(spark, sf_dir)
    name = f"evidence_{uuid.uuid4().hex}"
    where = shared(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    stream = V.document_stream(spark, f"{sf_dir}/documents.parquet*", schema, 100)
    V.run_once(V.validate_stream(stream, PACKAGE[:2] + PACKAGE[3:4]).select("doc_id", "rule_ix", "status"), f"{where}/{name}", f"{where}/{name}-log")
    out = reliable(spark.read.parquet(f"{where}/{name}").groupBy("rule_ix", "status").agg(F.count("*").alias("n")))
    for path in (f"{where}/{name}", f"{where}/{name}-log"):
        remove(spark, path)
    return out


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sessions(spark.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, LAW, "doc_id long, text string").select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("ix", "sentence")).select("doc_id", F.col("ix").cast("long").alias("ix"), "sentence")


CHAPTERS = [(1, "# 第一部分\n" + "甲" * 60 + "\n## 第一节\n" + "乙" * 60 + "\n# 第二部分\n" + "丙" * 60)]


def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chapters(frame(spark, CHAPTERS, "doc_id long, text string")).select("doc_id", F.col("chapter_ix").cast("long").alias("chapter_ix"), "title", F.col("level").cast("long").alias("level"), F.length("body").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    alias_expansion, field_normalise, taxonomy, taxonomy_faults, term_overlap, whitelist_check, origin_verification, template_extraction, keyword_scan, candidate_rules, modal_rules, document_units, concept_extraction, three_gates,
    adversarial_suite, perturbed_texts, gold_scoring, dual_path, threshold_calibration, soft_compare, nb_feedback, qa_numeric_lookup, outer_sentences, stream_validate, event_windows, event_sessions, sentence_split, chapter_split,
)}
_OUTCOME = "CASE WHEN status = expected THEN 'correct' WHEN status = 'FAILED' THEN 'false_positive' WHEN expected = 'FAILED' THEN 'false_negative' ELSE 'wrong' END"
_OVERLAP = "CASE WHEN length({b}) = 0 THEN 0 ELSE 0.4 * len(list_intersect(list_distinct(string_split({a}, '')), list_distinct(string_split({b}, ''))))::DOUBLE / greatest(len(list_distinct(list_concat(string_split({a}, ''), string_split({b}, '')))), 1) + 0.6 * len(list_intersect({ga}, {gb}))::DOUBLE / greatest(len(list_distinct(list_concat({ga}, {gb}))), 1) END"
_BI = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
ORACLES = {
    "alias_expansion": "SELECT * FROM " + values(EXPANDED, "rule_id", "terms"),
    "field_normalise": "WITH f AS (SELECT * FROM " + values(FIELDS, "field") + "), s AS (SELECT * FROM " + values(SURFACES, "surface", "canonical") + ") SELECT f.field, coalesce(arg_max(s.canonical, (s.surface = f.field, length(s.surface))), f.field) AS canonical FROM f LEFT JOIN s ON contains(f.field, s.surface) GROUP BY 1",
    "taxonomy": "SELECT n_name AS child, r_name AS ancestor, 1::BIGINT AS distance FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'WORLD', 2 FROM nation UNION ALL SELECT DISTINCT r_name, 'WORLD', 1 FROM region JOIN nation ON n_regionkey = r_regionkey",
    "taxonomy_faults": "SELECT '甲' AS concept, 'cycle' AS fault UNION ALL SELECT '乙', 'cycle' UNION ALL SELECT '工程', 'orphan'",
    "term_overlap": "SELECT p_partkey, round(" + _OVERLAP.format(a="'part number 12'", b="p_name", ga=_BI.format("'part number 12'"), gb=_BI.format("p_name")) + ", 6)::DOUBLE AS overlap FROM part",
    "whitelist_check": "SELECT * FROM " + values([("保修期限", "exact"), ("保修", "substring"), ("屋面期限", "ending"), ("违约金额", "substring"), ("天气", None)], "term", "how"),
    "origin_verification": "SELECT * FROM " + values([(1, "保修", 0.4), (2, "付款", 0.8), (3, "付款", 0.4)], "id", "terms", "confidence"),
    "concept_extraction": "WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM benchmark), w AS (SELECT term, count(*) AS freq FROM t WHERE length(term) BETWEEN 2 AND 8 GROUP BY 1 HAVING count(*) >= 2) SELECT term, freq, freq::DOUBLE AS score FROM w ORDER BY freq DESC, term LIMIT 50",
    "three_gates": _EV + ", x AS (SELECT 'FAILED' AS f, doc_id FROM labels WHERE quality = 0), b AS (SELECT rule_id, count(*) FILTER (status = 'NOT_APPLICABLE')::DOUBLE / count(*) <= 0.85 AS applicable FROM e WHERE rule_ix IN (2, 4) GROUP BY 1), n AS (SELECT rule_id, bool_and(status = 'FAILED') AS negatives FROM e JOIN x USING (doc_id) WHERE rule_ix IN (2, 4) GROUP BY 1) SELECT rule_id, applicable, coalesce(negatives, true) AS negatives FROM b LEFT JOIN n USING (rule_id)",
    "adversarial_suite": "SELECT * FROM " + values([("cn-1", "at", "保修期限为5年。", "PASSED"), ("cn-1", "below", "保修期限为4年。", "FAILED"), ("cn-1", "above", "保修期限为6年。", "PASSED"), ("cn-1", "deletion", "双方另行约定年。", "NOT_APPLICABLE"), ("cn-2", "at", "违约金为3%。", "PASSED"), ("cn-2", "below", "违约金为2%。", "PASSED"), ("cn-2", "above", "违约金为4%。", "FAILED"), ("cn-2", "deletion", "双方另行约定%。", "NOT_APPLICABLE")], "rule_id", "kind", "text", "expected"),
    "perturbed_texts": "SELECT doc_id, 'synonym' AS kind, length(replace(text, 'the ', 'that ')) AS n FROM documents WHERE contains(text, 'the ') UNION ALL SELECT doc_id, 'split', length(replace(text, 'the ', 't he ')) FROM documents WHERE contains(text, 'the ') UNION ALL SELECT doc_id, 'synonym', length(replace(text, 'und ', 'oder ')) FROM documents WHERE contains(text, 'und ') UNION ALL SELECT doc_id, 'split', length(replace(text, 'und ', 'u nd ')) FROM documents WHERE contains(text, 'und ')",
    "gold_scoring": _EV + f", x AS (SELECT e.lang, {_OUTCOME} AS o FROM (SELECT doc_id, CASE WHEN quality = 0 THEN 'FAILED' ELSE 'PASSED' END AS expected FROM labels) JOIN e USING (doc_id) WHERE rule_ix = 0) SELECT lang, count(*) AS n, count(*) FILTER (o = 'correct') AS correct, round(count(*) FILTER (o = 'correct')::DOUBLE / count(*), 6) AS accuracy, count(*) FILTER (o = 'false_positive') AS false_positives FROM x GROUP BY ROLLUP (lang)",
    "dual_path": _EV + ", x AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'FAILED' ELSE 'PASSED' END AS expected FROM labels), y AS (SELECT a.status = expected AS p, b.status = expected AS q FROM x JOIN e a USING (doc_id) JOIN e b USING (doc_id) WHERE a.rule_ix = 0 AND b.rule_ix = 3) SELECT CASE WHEN NOT p AND q THEN 'FIXED' WHEN p AND NOT q THEN 'REGRESSION' WHEN NOT p THEN 'BOTH_WRONG' ELSE 'SAME' END AS change, count(*) AS n FROM y GROUP BY 1",
    "soft_compare": "WITH s AS (SELECT o_orderkey, o_orderstatus = 'F' AS y, 1 / (1 + exp(-(o_totalprice - 150000) / 20000)) AS s FROM orders) SELECT o_orderkey, round(s, 6) AS score, round(greatest(0, 0.5 - CASE WHEN y THEN s - 0.5 ELSE 0.5 - s END), 6) AS loss FROM s",
    "nb_feedback": "WITH g AS (SELECT event_type, count(*) / 1e6::DOUBLE AS p, count(*) FILTER (value > 90) AS n FROM events GROUP BY 1) SELECT event_type AS gram, round(ln(CASE WHEN n > 0 THEN 1 - (1 - p) * power(0.9995::DOUBLE, n) ELSE p END), 6) + 0.0::DOUBLE AS log_prob FROM g",
    "qa_numeric_lookup": "SELECT * FROM " + values([(q[0], *q[3:]) for q in QUESTIONS], "id", "route", "answer"),
    "outer_sentences": "WITH s AS (SELECT doc_id, text, unnest(list_distinct(string_split(text, chr(10)))) AS sentence FROM documents) SELECT sha256(sentence) AS sentence_sha256, count(*) AS n FROM s WHERE length(sentence) >= 8 AND NOT contains(substr(text, 1, 200), sentence) GROUP BY sentence HAVING count(*) >= 2",
    "stream_validate": _EV + " SELECT CASE rule_ix WHEN 3 THEN 2 ELSE rule_ix END AS rule_ix, status, count(*) AS n FROM e WHERE rule_ix IN (0, 1, 3) GROUP BY 1, 2",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s",
    "sentence_split": "SELECT * FROM " + values([(1, 0, "第四十条 屋面防水工程的保修期限，为5年。"), (1, 1, "保修期限不得低于2年。"), (1, 2, "承包人应当提供质量保修书。"), (2, 0, "禁止转包。"), (2, 1, "发包人不得指定分包单位。"), (2, 2, "逾期违约金不超过合同总价的百分之五；"), (2, 3, "工程款应当在30日内支付。"), (3, 0, "没有规则的句子。")], "doc_id", "ix", "sentence"),
    "chapter_split": "SELECT * FROM " + values([(1, 0, "第一部分", 1, 128), (1, 1, "第一节", 2, 60), (1, 2, "第二部分", 1, 60)], "doc_id", "chapter_ix", "title", "level", "n"),
}
