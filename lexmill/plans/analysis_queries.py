"""Queries on classification, scores, graphs, constraints and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as K
from ..operators import clusters as U
from ..operators import constraints as S
from ..operators import graph as G
from ..operators import mining as M
from .inline import frame, values
from .rule_queries import _EV, docs, package_evidence, package_verdicts

R6 = lambda c: F.round(c, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- lexical prototypes: languages are domains, letter bigrams the features ----


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good, with their language as domain."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return docs(spark, sf_dir).join(good, "doc_id", "left_semi")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bigram_rows(_corpus(spark, sf_dir), "doc_id", letters=True, keep=("lang",))


def lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = K.bigram_rows(table(spark, sf_dir, "benchmark"), "item_id", letters=True)
    return K.coverage(items, K.build_prototypes(_rows(spark, sf_dir), "lang"), "item_id").select("item_id", "domain", R6("coverage").alias("coverage"))


def lexical_loo_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.loo_thresholds(_rows(spark, sf_dir), "lang", "doc_id").select("lang", "samples", R6("mean").alias("mean"), R6("threshold").alias("threshold"))


def lexical_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = K.bigram_rows(table(spark, sf_dir, "benchmark"), "item_id", letters=True)
    rows = _rows(spark, sf_dir)
    limits = K.loo_thresholds(rows, "lang", "doc_id").select(F.col("lang").alias("domain"), "threshold")
    return K.lexical_domains(K.coverage(items, K.build_prototypes(rows, "lang"), "item_id"), limits, "item_id")


def jaccard_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.similar(K.build_prototypes(_rows(spark, sf_dir), "lang"), 0.2).select("a", "b", R6("similarity").alias("similarity"))


def nb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the benchmark's items, by Naive Bayes on letter bigrams."""
    grams, classes = K.nb_train(_rows(spark, sf_dir).withColumnRenamed("bigram", "gram"), "lang", "doc_id")
    return K.nb_predict(K.bigram_rows(table(spark, sf_dir, "benchmark"), "item_id", letters=True).withColumnRenamed("bigram", "gram"), grams, classes, "item_id").select("item_id", F.col("class").alias("lang"))


_GRAMS = "list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))"
_PROTO = f"""WITH ls AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
    c AS (SELECT doc_id, lang, unnest({_GRAMS}) AS g FROM ls), li AS (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM benchmark),
    p AS (SELECT DISTINCT lang AS domain, g FROM c), i AS (SELECT item_id, unnest({_GRAMS}) AS g FROM li),
    cov AS (SELECT item_id, domain, count(*)::DOUBLE / n AS coverage FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM i) JOIN p USING (g) GROUP BY item_id, domain, n),
    loo AS (SELECT lang, count(*) AS samples, avg(c) AS mean, greatest(0.01, avg(c) - 2 * stddev_pop(c)) AS threshold FROM
            (SELECT lang, doc_id, count(*) FILTER (df >= 2)::DOUBLE / count(*) AS c FROM (SELECT *, count(*) OVER (PARTITION BY lang, g) AS df FROM c) GROUP BY 1, 2) GROUP BY 1)"""

TERM_SETS = {
    "english": {"positive": ["the", "and", "with", "from", "that"], "negative": ["der", "que"], "weight": 1.0},
    "german": {"positive": ["und", "der", "die", "nicht", "ver"], "negative": ["the", "que"], "weight": 0.9},
    "romance": {"positive": ["que", "les", "de la", "est", "por"], "negative": ["und", "the"], "weight": 0.8},
}


def domain_term_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", K.term_set_domain(F.col("text"), TERM_SETS).alias("d")).select("doc_id", "d.domain", R6(F.col("d.confidence")).alias("confidence"))


def _term_sql() -> str:
    def score(cfg: dict) -> str:
        hits = " + ".join(f"contains(text, '{t}')::INT" for t in cfg["positive"])
        against = " + ".join(f"contains(text, '{t}')::INT" for t in cfg["negative"])
        return f"least(greatest(({hits}) / {len(cfg['positive'])}.0::DOUBLE * {cfg['weight']} - least(({against}) / {len(cfg['negative'])}.0::DOUBLE * 0.5, 0.5), 0) + CASE WHEN ({hits}) >= 2 THEN 0.05 ELSE 0 END, 1)"

    rows = " UNION ALL ".join(f"SELECT doc_id, '{d}' AS d, {score(cfg)} AS s FROM documents" for d, cfg in TERM_SETS.items())
    return f"""
        WITH s AS ({rows}), r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS second FROM s WHERE s > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, d))
        SELECT doc_id, CASE WHEN s IS NULL OR s < 0.15 THEN '未知' WHEN s - second < 0.10 AND s <= 0.20 THEN '未知' ELSE d END AS domain,
               round(CASE WHEN s IS NULL THEN 0 WHEN s < 0.15 THEN s WHEN s - second < 0.10 THEN least(0.3 + (s - second) * 2, 0.65) ELSE least(s + 0.15, 0.95) END, 6)::DOUBLE AS confidence
        FROM documents LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (doc_id)"""


def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("lang", F.col("n_chars").cast("long").alias("n")).withColumn("bin", (F.col("n") / 1000).cast("int"))
    return K.adjusted_rand(rows, "lang", "bin").select(R6("ari").alias("ari"))


def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of each vector to the mean of its label."""
    e = table(spark, sf_dir, "embeddings")
    long = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return e.join(F.broadcast(mean), "label").select("vec_id", F.round(K.cosine(F.col("embedding"), F.col("mean")), 4).alias("similarity"))


def hybrid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each vector to the next one."""
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(after, "vec_id").select("vec_id", F.round(K.hybrid_distance(F.col("embedding"), F.col("after")), 4).alias("distance"))


def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.dbscan(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35, 2)


def mahalanobis_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each vector to its label's prototype."""
    e = table(spark, sf_dir, "embeddings")
    return K.mahalanobis_distances(e, K.mahalanobis_prototypes(e, "label", "embedding"), "label", "embedding").select("vec_id", "distance")


# ---- credibility, layers, triage ----

SOURCES = [("官方机构", "manual", 0.9, 0.8, True, True), ("学术期刊", "keyword_scan", 0.7, 0.5, False, True), ("LLM提取", "llm_extract", 0.2, 0.3, False, False), ("传闻", "other", 1.0, 1.0, True, False)]
PAPERS = [(1, "Nature", 1500, "rct", "manual"), (2, "arXiv", 5, "unknown", "llm_extract"), (3, "Q2", 120, "cohort", "structured_parse"), (4, "blog", 0, "case_report", "keyword_scan"), (5, "Q1", 10, "meta_analysis", "llm_extract")]
CHAIN = [
    (1, "FAILED", 0.9, "manual", "Field 'x': contract value 3年 FAILS legal threshold (>= 5年). Gap: 2年.", ["保修", "期限"], 0.1, "error"),
    (2, "FAILED", 0.2, "keyword_scan", "Forbidden term(s) found.", ["转包"], 0.5, "warning"),
    (3, "PASSED", 0.9, "manual", "ok", [], 0.0, "error"),
    (4, "FAILED", 0.95, "structured", "(<= 3%) Gap: 0.2%", ["a", "质保金", "质量", "比例", "付款"], 0.8, "info"),
    (5, "FAILED", 1.0, "manual", "forbidden", ["一一", "二二", "三三", "四四", "五五", "六六"], 0.0, "error"),
]


def source_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame(spark, SOURCES, "source_type string, method string, authority double, consistency double, cited boolean, verified boolean")
    return s.select("source_type", R6(K.credibility(*(F.col(c) for c in s.columns))).alias("credibility"))


def academic_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame(spark, PAPERS, "prop_id long, venue string, citations long, study string, method string")
    score = K.paper_credibility(F.col("venue"), F.col("citations"), F.col("study"), F.col("method"))
    return p.select("prop_id", R6(score).alias("credibility"), K.layer(score).alias("layer"))


def _triaged(spark: SparkSession) -> DataFrame:
    c = frame(spark, CHAIN, "ev_id long, status string, credible double, method string, rationale string, terms array<string>, entropy double, severity string")
    score = K.triage_score(K.triage_signals(*(F.col(k) for k in ("credible", "method", "rationale", "terms", "entropy", "severity"))))
    return c.select("ev_id", "status", score.alias("score"), K.triage(F.col("status"), score).alias("verdict"))


def triage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark).select("ev_id", F.when(F.col("status") == "FAILED", R6("score")).alias("score"), "verdict")


def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the triage of a package's evidence, counted."""
    e = package_evidence(spark, sf_dir)
    score = K.triage_score(K.triage_signals(F.col("source_credibility"), F.col("extraction_method"), F.col("rationale"), F.col("matched_terms"), F.lit(0.0), F.col("severity")))
    return e.groupBy("rule_id", K.triage(F.col("status"), score).alias("verdict")).agg(F.count("*").alias("n"))


# ---- rule graph and beliefs ----

RULE_ROWS = [
    ("cn-1", "保修期限", "质量", "保修", ["保修期限", "质量保修书"]), ("cn-2", "质量保修书", "质量", "保修", ["质量保修书"]), ("cn-3", "付款比例", "资金", "付款", ["付款比例", "预付款"]),
    ("cn-4", "预付款", "资金", "付款", ["预付款"]), ("cn-5", "仲裁条款", "争议", "争议", ["仲裁", "管辖法院"]), ("cn-6", "安全生产", "安全", "安全", ["安全"]),
]
_RULES_SQL = values(RULE_ROWS, "rule_id", "name", "category", "clause_type", "entities")


def _rules(spark: SparkSession) -> DataFrame:
    return frame(spark, RULE_ROWS, "rule_id string, name string, category string, clause_type string, entities array<string>")


def rule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(_rules(spark)).select("src", "dst", "edge_type", R6("weight").alias("weight"))


_CHAIN_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(name || ' ' || array_to_string(entities, ' '), '{'|'.join(h)}') THEN '{k}' END" for k, h in G.CHAINS.items()) + "]"
_EDGES = f"""WITH r AS (SELECT * FROM {_RULES_SQL}), one AS (
    SELECT a.rule_id AS src, b.rule_id AS dst, 'SHARES_ENTITY' AS edge_type, least(1, 2 * len(list_intersect(a.entities, b.entities))::DOUBLE / len(list_distinct(list_concat(a.entities, b.entities)))) AS weight FROM r a JOIN r b ON a.rule_id < b.rule_id WHERE len(list_intersect(a.entities, b.entities)) > 0
    UNION ALL SELECT a.rule_id, b.rule_id, 'SAME_CATEGORY', 0.5 FROM r a JOIN r b ON a.rule_id < b.rule_id AND a.category = b.category
    UNION ALL SELECT a.rule_id, b.rule_id, 'CLAUSE_TYPE_CHAIN', 0.4 FROM r a JOIN r b ON a.rule_id < b.rule_id AND a.clause_type = b.clause_type
    UNION ALL SELECT a.rule_id, b.rule_id, 'LOGICAL_CHAIN', 0.6 FROM (SELECT rule_id, unnest({_CHAIN_SQL}) AS f FROM r) a JOIN (SELECT rule_id, unnest({_CHAIN_SQL}) AS f FROM r) b ON a.f = b.f AND a.rule_id < b.rule_id),
    edges AS (SELECT * FROM one UNION ALL SELECT dst, src, edge_type, weight FROM one)"""


def rule_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark)
    return G.closure(rules, G.edges(rules))


PACKAGE_LINKS = [("p1", "p2"), ("p2", "p1"), ("p3", "p4"), ("p4", "p3")]


def dependency_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the failed rules of each document, with links between some rules of the package."""
    return G.cause_rows(package_verdicts(spark, sf_dir), PACKAGE_LINKS)


def belief_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors = _rules(spark).select("rule_id", F.lit(0.6).alias("prior"))
    seen = frame(spark, [("cn-1", "FAILED"), ("cn-3", "PASSED"), ("cn-6", "NOT_APPLICABLE")], "rule_id string, status string")
    return G.propagate(priors, G.edges(_rules(spark)), seen)


def mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mermaid(frame(spark, PACKAGE_LINKS, "src string, dst string"))


def pair_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often pairs of rules agree over documents, as calibrated potentials."""
    runs = package_evidence(spark, sf_dir).where("rule_ix <> 3").select(F.col("doc_id").alias("run_id"), "rule_id", "status")
    return G.calibrated(runs).select("a", "b", *(R6(c).alias(c) for c in ("pp", "pf", "fp", "ff")))


# ---- constraints on orders and line items ----

CONSTRAINTS = [("price", ">=", 1000.0, "法 1"), ("price", "<=", 300000.0, "规范 2"), ("items", "<=", 5.0, "条例 3"), ("discount", "<", 0.35, "规范 4"), ("保修", ">=", 2.0, "法 5")]
_CON_SQL = values(CONSTRAINTS, "field", "operator", "threshold", "legal_ref")


def _con(spark: SparkSession) -> DataFrame:
    return frame(spark, CONSTRAINTS, "field string, operator string, threshold double, legal_ref string")


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each order: its price, its number of items and its summed discount."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").cast("double").alias("items"), F.round(F.sum("l_discount"), 4).alias("discount"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("price"))
    return o.join(li, "doc_id").selectExpr("doc_id", "stack(3, 'price', price, 'items', items, 'discount', discount) as (field, value)")


_PROPS_SQL = """WITH li AS (SELECT l_orderkey AS doc_id, count(*)::DOUBLE AS items, round(sum(l_discount), 4) AS discount FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS doc_id, o_totalprice AS price, items, discount FROM orders JOIN li ON o_orderkey = doc_id),
    p AS (SELECT doc_id, 'price' AS field, price AS value FROM o UNION ALL SELECT doc_id, 'items', items FROM o UNION ALL SELECT doc_id, 'discount', discount FROM o),
    v AS (SELECT doc_id, field, value, operator, threshold, CASE WHEN operator IN ('>=', '>') THEN threshold - value ELSE value - threshold END AS gap, legal_ref FROM p JOIN {con} c USING (field)
          WHERE NOT CASE operator WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '<' THEN value < threshold END)""".format(con=_CON_SQL)


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.check(_props(spark, sf_dir), _con(spark))


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.violations(_props(spark, sf_dir), _con(spark)).withColumns({"gap": F.round("gap", 4), "value": F.round("value", 4)})


def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.what_if(_props(spark, sf_dir), _con(spark), "price").select("doc_id", "total", "violated", "verdict")


def counterfactual_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What half the price, two items more and no discount at all would do to each order's constraints."""
    changes = {"price": F.col("value") / 2, "items": F.col("value") + 2, "discount": None}
    return S.counterfactual(_props(spark, sf_dir), _con(spark), changes).select("doc_id", "field", "fixed", "broken", "impact")


def fix_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fixes(_props(spark, sf_dir), _con(spark)).select("doc_id", "field", R6("threshold").alias("threshold"), F.round("suggested", 4).alias("suggested"), F.col("rank").cast("long").alias("rank"))


def unbound_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = frame(spark, [("比例", ">=", 5.0, ""), ("比例", "<=", 3.0, ""), ("工期", ">", 10.0, ""), ("工期", "<=", 10.0, "")], "field string, operator string, threshold double, legal_ref string")
    return S.unbound_conflicts(_con(spark).unionByName(more))


def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report(S.violations(_props(spark, sf_dir).where("field = 'items'"), _con(spark)))


# ---- mining over the event stream: a user is a run, types of events are terms ----


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id")).alias("run_id"), F.concat(F.col("event_type"), F.floor(F.hour("ts") / 6).cast("string")).alias("term"))


_TERMS_SQL = "WITH t AS (SELECT DISTINCT user_id AS run, lower(trim(event_type || floor(hour(ts) / 6)::INT)) AS term FROM events), k AS (SELECT term, count(*) AS k FROM t GROUP BY 1), n AS (SELECT count(DISTINCT run) AS n FROM t), c AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM t a JOIN t b ON a.run = b.run AND a.term < b.term GROUP BY 1, 2)"


def assoc_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of documents that meet far more often than by chance."""
    t = docs(spark, sf_dir).select(F.col("doc_id").alias("run_id"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")).where("term <> ''")
    return M.positive(t).select("a", "b", "n", *(R6(c).alias(c) for c in ("support", "confidence", "lift")))


def assoc_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select(F.col("doc_id").alias("run_id"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")).where("term <> ''")
    return M.negative(t)


def event_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often types of events (by quarter of the day) meet in one user's stream."""
    t = _terms(spark, sf_dir).select("run_id", F.lower("term").alias("term")).distinct()
    return t.withColumnRenamed("term", "a").join(t.withColumnRenamed("term", "b"), "run_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


_WORDS_SQL = "WITH t AS (SELECT DISTINCT doc_id AS run, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents), u AS (SELECT * FROM t WHERE term <> ''), k AS (SELECT term, count(*) AS k FROM u GROUP BY 1), n AS (SELECT count(DISTINCT run) AS n FROM u), f AS (SELECT term, k FROM k, n WHERE k >= 0.1 * n.n), x AS (SELECT u.* FROM u SEMI JOIN f USING (term)), c AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM x a JOIN x b ON a.run = b.run AND a.term < b.term GROUP BY 1, 2)"


def chi_squared_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a letter bigram depends on English, over labelled documents."""
    rows = _rows(spark, sf_dir)
    n = rows.select("doc_id", "lang").distinct().agg(F.count("*").alias("all"), F.count_if(F.col("lang") == "en").alias("en"))
    k = rows.groupBy("bigram").agg(F.count_if(F.col("lang") == "en").alias("o11"), F.count_if(F.col("lang") != "en").alias("o12")).join(F.broadcast(n))
    chi, p = M.chi_squared(F.col("o11"), F.col("o12"), F.col("en") - F.col("o11"), F.col("all") - F.col("en") - F.col("o12"))
    return k.select("bigram", F.round(chi, 4).alias("chi2"), F.round(p, 5).alias("p"))


def vocabulary_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohesion of letter bigrams inside words of all documents."""
    words = docs(spark, sf_dir).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    at = lambda k: F.explode(F.expr(f"transform(sequence(1, length(w) - {k - 1}), i -> substring(w, i, {k}))"))
    grams = words.where("length(w) >= 2").select("n", at(2).alias("bigram")).groupBy("bigram").agg(F.sum("n").alias("n"))
    chars = words.select("n", at(1).alias("char")).groupBy("char").agg(F.sum("n").alias("n"))
    return M.cohesion(grams, chars).select("bigram", "n", R6("pmi").alias("pmi"))


GROUPS = [("english", "the"), ("english", "and"), ("german", "und"), ("german", "der"), ("romance", "que"), ("romance", "les")]


def term_group_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = docs(spark, sf_dir).select(F.col("doc_id").alias("ev_id"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")).where("term <> ''")
    return M.group_cooccurrence(terms, frame(spark, GROUPS, "group string, term string")).select("term", "group", R6("share").alias("share"))


def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of orders as a model has them, from the lines that weren't returned, and as patterns have them, from all lines that were shipped."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lambda some: some.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("value"))
    model = sums(lines.where("l_returnflag <> 'R'")).withColumn("confidence", F.when(F.col("k") % 2 == 0, 0.7).otherwise(0.9))
    return M.fuse(model, sums(lines.where("l_linestatus = 'F'")), ["k"]).withColumns({c: F.round(c, 4) for c in ("model_value", "regex_value", "model_confidence", "regex_confidence")})


CLAIMS = [(1, 10, ["method a", "accuracy"], 1), (2, 11, ["accuracy"], -1), (3, 11, ["method a"], 1), (4, 12, ["method a", "speed"], -1), (5, 12, ["speed"], 0), (6, 10, ["speed"], 1)]


def cross_paper_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contradictions(frame(spark, CLAIMS, "claim_id long, paper_id long, subjects array<string>, direction long"))


QUERIES = {f.__name__: f for f in (
    lexical_coverage, lexical_loo_threshold, lexical_domains, jaccard_similar, nb_classify, domain_term_set, adjusted_rand, embedding_cosine, hybrid_distance, dbscan_clusters, mahalanobis_distance,
    source_credibility, academic_layers, triage_scores, triage_summary, rule_edges, rule_closure, dependency_resolve, belief_propagation, mermaid, pair_potentials,
    constraint_check, constraint_violations, what_if, counterfactual_diff, fix_ranking, unbound_conflicts, conflict_report,
    assoc_positive, assoc_negative, event_associations, chi_squared_bigrams, vocabulary_pmi, term_group_cooccurrence, evidence_fusion, cross_paper_contradictions,
)}
_TYPE = {"官方机构": 1.0, "学术期刊": 0.95, "LLM提取": 0.35}
ORACLES = {
    "lexical_coverage": _PROTO + " SELECT item_id, domain, round(coverage, 6) AS coverage FROM cov",
    "lexical_loo_threshold": _PROTO + " SELECT lang, samples, round(mean, 6) AS mean, round(threshold, 6) AS threshold FROM loo",
    "lexical_domains": _PROTO + """, r AS (SELECT item_id, domain, coverage, coverage >= threshold AS above, row_number() OVER w AS k FROM cov JOIN loo ON lang = domain WINDOW w AS (PARTITION BY item_id ORDER BY coverage DESC, domain)),
        s AS (SELECT *, bool_or(above) OVER p AS found, max(coverage) FILTER (k = 1) OVER p AS top, coalesce(max(coverage) FILTER (k = 2) OVER p, 0) AS second FROM r WINDOW p AS (PARTITION BY item_id))
        SELECT item_id, domain FROM s WHERE found AND CASE WHEN second = 0 OR top >= 2 * second THEN k = 1 ELSE above END""",
    "jaccard_similar": _PROTO + " SELECT a, b, round(k / (n1 + n2 - k)::DOUBLE, 6) AS similarity FROM (SELECT a.domain AS a, b.domain AS b, count(*) AS k FROM p a JOIN p b ON a.g = b.g AND a.domain < b.domain GROUP BY 1, 2) JOIN (SELECT domain AS a, count(*) AS n1 FROM p GROUP BY 1) USING (a) JOIN (SELECT domain AS b, count(*) AS n2 FROM p GROUP BY 1) USING (b) WHERE k / (n1 + n2 - k)::DOUBLE >= 0.2",
    "nb_classify": _PROTO + """, v AS (SELECT g, count(*) AS df FROM c GROUP BY 1), nd AS (SELECT count(DISTINCT doc_id) AS n FROM c), nv AS (SELECT count(*) AS v FROM v),
        pr AS (SELECT lang, ln(count(DISTINCT doc_id)::DOUBLE / any_value(n)) AS prior, count(*) AS total FROM c, nd GROUP BY 1), kk AS (SELECT lang, g, count(*) AS k FROM c GROUP BY 1, 2),
        s AS (SELECT item_id, lang, any_value(prior) + sum((ln((n + 1.0) / df) + 1) * ln((coalesce(k, 0) + 1.0) / (total + v))) AS score
              FROM i JOIN v USING (g) CROSS JOIN pr CROSS JOIN nd CROSS JOIN nv LEFT JOIN kk USING (lang, g) GROUP BY 1, 2)
        SELECT item_id, arg_max(lang, score) AS lang FROM s GROUP BY 1""",
    "domain_term_set": _term_sql(),
    "adjusted_rand": "WITH c AS (SELECT lang, floor(n_chars / 1000) AS bin, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS o, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY lang)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY bin)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) SELECT round((o - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM s",
    "embedding_cosine": "WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM l GROUP BY 1, 2) SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 4) AS similarity FROM l JOIN m USING (label, i) GROUP BY 1",
    "source_credibility": "SELECT t AS source_type, round(least(1, 0.3 * s + 0.2 * m + 0.2 * a + 0.15 * c + CASE WHEN x AND y THEN 0.045 WHEN x THEN 0.02 WHEN y THEN 0.025 ELSE 0 END), 6)::DOUBLE AS credibility FROM " + values([(t, _TYPE.get(t, 0.3), K.METHODS.get(m, 0.3), a, c, x, y) for t, m, a, c, x, y in SOURCES], "t", "s", "m", "a", "c", "x", "y"),
    "academic_layers": "SELECT id AS prop_id, round(s, 6)::DOUBLE AS credibility, CASE WHEN s >= 0.8 THEN 'L0_VALIDATED' WHEN s >= 0.55 THEN 'L1_CONJECTURE' WHEN s >= 0.25 THEN 'L2_SOURCE_UNCERTAIN' ELSE 'L3_OUTER_POSSIBILITY' END AS layer FROM (SELECT id, v * 0.4 + CASE WHEN c >= 1000 THEN 1 WHEN c >= 100 THEN 0.8 WHEN c >= 10 THEN 0.5 WHEN c > 0 THEN 0.3 ELSE 0.15 END * 0.25 + s * 0.2 + m * 0.15 AS s FROM " + values([(1, 1.0, 1500, 0.9, 1.0), (2, 0.3, 5, 0.3, 0.5), (3, 0.65, 120, 0.7, 0.85), (4, 0.05, 0, 0.15, 0.35), (5, 0.85, 10, 1.0, 0.5)], "id", "v", "c", "s", "m") + ")",
    "triage_scores": "SELECT ev_id, round(s, 6)::DOUBLE AS score, CASE WHEN s IS NULL THEN 'PASS' WHEN s >= 0.8 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END AS verdict FROM " + values([(1, round((0.9 + 0.8 + 1.2 * (0.5 + (2 - 0.75) / 1.5 * 0.3) + 0.6 * 0.45 + 0.9 + 0.5) / 5.0, 6)), (2, round(((0.10 + 0.2 / 0.3 * 0.05) + 0.8 * 0.4 + 1.2 + 0.6 * 0.25 + 0.9 * (1 - 0.2 / 0.4 * 0.8) + 0.5 * 0.6) / 5.0, 6)), (3, None), (4, round((0.95 + 0.8 * 0.95 + 1.2 * (0.2 / 0.45 * 0.5) + 0.6 * (0.75 - 0.06) + 0.9 * (0.2 - 0.1 / 0.3 * 0.2) + 0.15) / 5.0, 6)), (5, round((1 + 0.8 + 1.2 + 0.6 * 0.8 + 0.9 + 0.5) / 5.0, 6))], "ev_id", "s"),
    "triage_summary": _EV + """, g AS (SELECT rule_id, CASE WHEN status <> 'FAILED' THEN 'PASS' WHEN (0.45 + 0.8 + 1.2 + 0.6 * CASE WHEN matched = '' THEN 0.05 WHEN contains(matched, ',') THEN 0.45 ELSE 0.25 END + 0.9 + 0.5 * CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 0.6 ELSE 0.3 END) / 5 >= 0.8 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END AS verdict FROM e) SELECT rule_id, verdict, count(*) AS n FROM g GROUP BY 1, 2""",
    "hybrid_distance": "SELECT a.vec_id, round(greatest(0, 1 - (0.3 * list_cosine_similarity(x[1:6], y[1:6]) + 0.2 * list_cosine_similarity(x[7:10], y[7:10]) + 0.5 * list_cosine_similarity(x, y))), 4) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS y FROM embeddings) b USING (vec_id)",
    "rule_edges": _EDGES + " SELECT src, dst, edge_type, round(weight, 6)::DOUBLE AS weight FROM edges",
    "rule_closure": _EDGES.replace("WITH r", "WITH RECURSIVE r") + ", reach AS (SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM reach a JOIN edges b ON a.dst = b.src) SELECT DISTINCT src, dst FROM reach WHERE src <> dst",
    "dependency_resolve": _EV + f""", x AS (SELECT DISTINCT doc_id, rule_id FROM e WHERE status = 'FAILED'), h AS (SELECT DISTINCT a.doc_id, a.rule_id FROM x a JOIN {values(PACKAGE_LINKS, "src", "dst")} l ON a.rule_id = l.src JOIN x b ON a.doc_id = b.doc_id AND b.rule_id = l.dst)
        SELECT x.doc_id, x.rule_id, CASE WHEN h.rule_id IS NULL THEN 'root_cause' ELSE 'consequence' END AS causal_class, CASE WHEN h.rule_id IS NULL THEN 'isolated' ELSE 'consequence' END AS dependency_class FROM x LEFT JOIN h USING (doc_id, rule_id)""",
    "mermaid": "SELECT 'graph TD' || chr(10) || string_agg('    ' || src || ' --> ' || dst, chr(10) ORDER BY src, dst) AS text FROM " + values(PACKAGE_LINKS, "src", "dst"),
    "pair_potentials": _EV + """, r AS (SELECT doc_id, rule_id, status = 'PASSED' AS p FROM e WHERE rule_ix <> 3 AND status <> 'NOT_APPLICABLE')
        SELECT a.rule_id AS a, b.rule_id AS b, round((count(*) FILTER (a.p AND b.p) + 1) / (count(*) + 4.0::DOUBLE), 6) AS pp, round((count(*) FILTER (a.p AND NOT b.p) + 1) / (count(*) + 4.0::DOUBLE), 6) AS pf,
               round((count(*) FILTER (NOT a.p AND b.p) + 1) / (count(*) + 4.0::DOUBLE), 6) AS fp, round((count(*) FILTER (NOT a.p AND NOT b.p) + 1) / (count(*) + 4.0::DOUBLE), 6) AS ff
        FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rule_id < b.rule_id GROUP BY 1, 2""",
    "constraint_check": _PROPS_SQL + f" SELECT doc_id, {len(CONSTRAINTS)}::BIGINT AS total, coalesce(n, 0) AS violated, CASE WHEN n IS NULL THEN 'SATISFIABLE' ELSE 'VIOLATED' END AS verdict FROM o LEFT JOIN (SELECT doc_id, count(*) AS n FROM v GROUP BY 1) USING (doc_id)",
    "constraint_violations": _PROPS_SQL + " SELECT doc_id, field, round(value, 4) AS value, operator, threshold, round(gap, 4) AS gap, legal_ref FROM v",
    "what_if": _PROPS_SQL + " SELECT doc_id, 3::BIGINT AS total, coalesce(n, 0) AS violated, CASE WHEN n IS NULL THEN 'SATISFIABLE' ELSE 'VIOLATED' END AS verdict FROM o LEFT JOIN (SELECT doc_id, count(*) AS n FROM v WHERE field <> 'price' GROUP BY 1) USING (doc_id)",
    "counterfactual_diff": _PROPS_SQL + """, n AS (SELECT doc_id, field, value, CASE field WHEN 'price' THEN value / 2 WHEN 'items' THEN value + 2 END AS new FROM p),
        j AS (SELECT n.*, CASE operator WHEN '>=' THEN value < threshold WHEN '<=' THEN value > threshold WHEN '<' THEN value >= threshold ELSE false END AS before,
            coalesce(CASE operator WHEN '>=' THEN new < threshold WHEN '<=' THEN new > threshold WHEN '<' THEN new >= threshold ELSE false END, false) AS after FROM n LEFT JOIN {con} c USING (field))
        SELECT doc_id, field, count(*) FILTER (before AND NOT after) AS fixed, count(*) FILTER (after AND NOT before) AS broken, count(*) FILTER (before AND NOT after) * 0.5::DOUBLE - count(*) FILTER (after AND NOT before) AS impact FROM j GROUP BY 1, 2""".format(con=_CON_SQL),
    "fix_ranking": _PROPS_SQL + " SELECT doc_id, field, round(threshold, 6) AS threshold, round(value, 4) AS suggested, row_number() OVER (PARTITION BY doc_id ORDER BY abs(value - threshold), field) AS rank FROM v",
    "unbound_conflicts": "SELECT '比例' AS field, 5.0::DOUBLE AS low, 3.0::DOUBLE AS high UNION ALL SELECT '工期', 10.0, 10.0",
    "conflict_report": _PROPS_SQL + " SELECT doc_id, field || ': ' || operator || ' ' || threshold || ', actual ' || value || ' (' || legal_ref || ')' AS text FROM v WHERE field = 'items'",
    "assoc_positive": _WORDS_SQL + " SELECT a, b, c.n, round(c.n::DOUBLE / n.n, 6) AS support, round(c.n::DOUBLE / ka.k, 6) AS confidence, round(c.n::DOUBLE / ka.k / (kb.k::DOUBLE / n.n), 6) AS lift FROM c, n, k ka, k kb WHERE ka.term = a AND kb.term = b AND c.n >= 3 AND c.n::DOUBLE / n.n >= 0.1 AND c.n::DOUBLE / ka.k / (kb.k::DOUBLE / n.n) >= 2",
    "assoc_negative": _WORDS_SQL + " SELECT x.term AS a, y.term AS b, x.k AS ka, y.k AS kb FROM f x JOIN f y ON x.term < y.term ANTI JOIN c ON c.a = x.term AND c.b = y.term",
    "event_associations": _TERMS_SQL + " SELECT a, b, n FROM c",
    "chi_squared_bigrams": _PROTO + """, n AS (SELECT count(*)::DOUBLE AS m, count(*) FILTER (lang = 'en')::DOUBLE AS en FROM (SELECT DISTINCT doc_id, lang FROM c)),
        o AS (SELECT g, count(*) FILTER (lang = 'en')::DOUBLE AS a, count(*) FILTER (lang <> 'en')::DOUBLE AS b FROM c GROUP BY 1),
        q AS (SELECT g, a, b, en - a AS c, m - en - b AS d, m FROM o, n),
        x AS (SELECT g, CASE WHEN c + d > 0 AND a + c > 0 AND b + d > 0 THEN power(abs(a - (a + b) * (a + c) / m) - 0.5, 2) / ((a + b) * (a + c) / m) + power(abs(b - (a + b) * (b + d) / m) - 0.5, 2) / ((a + b) * (b + d) / m) + power(abs(c - (c + d) * (a + c) / m) - 0.5, 2) / ((c + d) * (a + c) / m) + power(abs(d - (c + d) * (b + d) / m) - 0.5, 2) / ((c + d) * (b + d) / m) ELSE 0 END AS chi FROM q),
        y AS (SELECT *, 1 / (1 + 0.2316419 * sqrt(chi)) AS t FROM x)
        SELECT g AS bigram, round(chi, 4) AS chi2, round(CASE WHEN chi > 0 THEN least(1, 2 * 0.3989422804014327 * exp(-chi / 2) * (t * (0.319381530 + t * (-0.356563782 + t * (1.477937 + t * (-1.821255978 + t * 1.330274429)))))) ELSE 1 END, 5)::DOUBLE AS p FROM y""",
    "vocabulary_pmi": "WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents), u AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1), g AS (SELECT b, sum(n) AS n FROM (SELECT n, unnest(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) AS b FROM u) GROUP BY 1), h AS (SELECT c, sum(n) AS n FROM (SELECT n, unnest(string_split(w, '')) AS c FROM u) GROUP BY 1) SELECT b AS bigram, g.n::BIGINT AS n, round(log2((g.n::DOUBLE / (SELECT sum(n) FROM g)) / ((x.n::DOUBLE / (SELECT sum(n) FROM h)) * (y.n::DOUBLE / (SELECT sum(n) FROM h)))), 6) AS pmi FROM g JOIN h x ON x.c = b[1] JOIN h y ON y.c = b[2]",
    "term_group_cooccurrence": "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents), u AS (SELECT * FROM t WHERE term <> ''), g AS (SELECT * FROM " + values(GROUPS, "grp", "term") + "), pr AS (SELECT DISTINCT doc_id, grp FROM u JOIN g USING (term)), c AS (SELECT term, grp, count(*) AS n FROM u JOIN pr USING (doc_id) WHERE length(term) >= 2 AND term NOT IN (SELECT term FROM g) GROUP BY 1, 2), s AS (SELECT term, grp, n::DOUBLE / max(n) OVER (PARTITION BY term) AS share FROM c) SELECT term, grp AS \"group\", round(share, 6) AS share FROM s WHERE share >= 0.6",
    "evidence_fusion": """WITH m AS (SELECT l_orderkey AS k, sum(l_quantity) AS v, CASE WHEN l_orderkey % 2 = 0 THEN 0.7 ELSE 0.9 END AS c FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), r AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
        x AS (SELECT k, m.v AS a, r.v AS b, m.c AS c, coalesce(abs(m.v - r.v) < 0.01, false) AS same FROM m FULL JOIN r USING (k))
        SELECT k, round(a, 4) AS model_value, round(b, 4) AS regex_value, same AS agreement, round(CASE WHEN a IS NULL THEN 0 WHEN same THEN least(1, c * 1.2) ELSE c END, 4)::DOUBLE AS model_confidence, round(CASE WHEN b IS NULL THEN 0 WHEN same THEN 1 ELSE 0.95 END, 4)::DOUBLE AS regex_confidence FROM x""",
    "cross_paper_contradictions": "WITH c AS (SELECT id, paper, d, unnest(s) AS s FROM " + values(CLAIMS, "id", "paper", "s", "d") + ") SELECT a.id AS a, b.id AS b, min(a.s) AS subject FROM c a JOIN c b ON a.s = b.s AND a.paper < b.paper AND a.d = -b.d AND a.d <> 0 GROUP BY 1, 2",
}
