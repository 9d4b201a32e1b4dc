"""Queries on what is learned between runs: keyed state, stores, clusters that rows are matched to, classifiers that are kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import remove, shared
from ..functions import text as T
from ..operators import bootstrap as B
from ..operators import clusters as U
from ..operators import intervals as I
from ..operators import quantified as Q
from ..operators import tfidf
from ..operators.classify import bigram_rows
from ..operators.graph import reliable
from ..operators.rules import Rule
from ..operators.store import Centroids, PrototypeStore
from ..streaming import learner as L

#: Ids that are broadcast at most, so that texts aren't shuffled; more of them are joined by a shuffle.
MOST_IDS = 2_000_000

R6 = lambda c: F.round(c, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _folder(spark: SparkSession) -> Iterator[str]:
    path = f"{shared(spark)}/learned-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


# ---- a learner over events: users are texts, event types their labels ----

TYPES = ["click", "view", "purchase", "signup", "error"]
GROUPS = {f"k{i}": TYPES[i % 5] for i in range(10)}
RATE = 0.01


def evidence_of_events(events: DataFrame) -> DataFrame:
    """Events as evidence: the digits of `k` are the matched terms, small values pass, those given by hand have k = 5."""
    k = F.get_json_object("props", "$.k").cast("int")
    term = lambda c: F.concat(F.lit("k"), c.cast("int").cast("string"))
    terms = F.array(term(k % 10), term(F.floor(k / 10)), term((k * 7) % 10))
    return events.select(
        F.col("event_id").alias("ev_id"), "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("text_hash"), F.col("event_type").alias("clause_type"),
        F.when(F.col("value") > 10, "FAILED").otherwise("PASSED").alias("status"), terms.alias("terms"), (F.col("value") / 100).alias("boundary"), F.when(k == 5, "ground_truth").alias("label_source"), terms.alias("grams"),
    )


def first_model(spark: SparkSession) -> DataFrame:
    """The labels of events, all with the same weights."""
    p = [(c, g, 0.2 if g == "" else 0.05) for c in TYPES for g in ["", *GROUPS]]
    return spark.createDataFrame(p, "label string, gram string, p double").select("label", "gram", F.log("p").alias("log_prob"))


def _learned(spark: SparkSession, sf_dir: str, pick: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    with _folder(spark) as path:
        return reliable(pick(*L.run_learner(evidence_of_events(stream), GROUPS, first_model(spark), path, RATE)))


def learner_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of a stream of events, with how often each correction had come."""
    return _learned(spark, sf_dir, lambda signals, _: signals.select("ev_id", "text_hash", "old_label", "suggested", R6("confidence").alias("confidence"), "signal", "times", "accepted"))


def learner_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of labels' features after all accepted corrections."""
    return _learned(spark, sf_dir, lambda _, model: model.select("label", "gram", (R6("log_prob") + 0.0).alias("log_prob")))


# ---- clusters of embeddings with the documents' words ----


def cluster_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their documents: bad documents are noise, and noise goes to a near cluster; clusters are described, and every row is matched to them."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    points = table(spark, sf_dir, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id"), "text", "quality"), "vec_id", "left")
    bad = F.col("quality") == 0
    points = reliable(points.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.when(bad, -1).otherwise(F.col("label")).alias("cluster"), T.bigrams(F.col("text"), True).alias("grams")))
    given = reliable(U.absorb_noise(points, "vec_id"))
    with _folder(spark) as path:
        U.describe(given).write.parquet(path)
        kept = spark.read.parquet(path)
        near = U.match(given, kept, "vec_id").withColumnRenamed("cluster", "nearest")
        named = near.join(kept.select(F.col("cluster").alias("nearest"), "cluster_id", "members", "label"), "nearest", "left")
        out = given.select("vec_id", "cluster").join(named, "vec_id")
        return reliable(out.select("vec_id", "cluster", "cluster_id", F.col("members").alias("members"), "label", R6("distance").alias("distance")))


# ---- stores ----


def _store(spark: SparkSession, sf_dir: str, path: str) -> PrototypeStore:
    """Languages as candidate domains, fed in two batches that come twice, then French merged into Spanish."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    store = PrototypeStore(spark, path)
    for _ in range(2):
        for q in (1, 0):
            some = docs.where(F.col("quality") == q)
            grams = bigram_rows(some, "doc_id", letters=True, keep=("lang",)).select(F.col("lang").alias("domain"), F.col("bigram").alias("gram")).distinct()
            store.upsert(f"texts-{q}", grams, some.groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("samples")))
            store.record(f"verdicts-{q}", some.select(F.col("lang").alias("domain"), F.lit("PASSED" if q else "FAILED").alias("verdict")))
        store.merge("fr-es", spark.createDataFrame([("fr", "es")], "source string, target string"))
    return store


def prototype_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _folder(spark) as path:
        return reliable(_store(spark, sf_dir, path).domains())


def prototype_store_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items by the domains of a store."""
    with _folder(spark) as path:
        rows = bigram_rows(table(spark, sf_dir, "benchmark"), "item_id", letters=True).withColumnRenamed("bigram", "gram")
        return reliable(_store(spark, sf_dir, path).classify(rows, "item_id").withColumn("coverage", R6("coverage")))


def running_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of embeddings by label, fed label by quality of the document, one batch twice; then every row's nearest mean."""
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    vectors = table(spark, sf_dir, "embeddings").join(quality, "vec_id", "left")
    with _folder(spark) as path:
        store = Centroids(spark, path)
        for name, some in (("good", vectors.where("quality = 1")), ("bad", vectors.where("quality = 0")), ("good", vectors.where("quality = 1")), ("unknown", vectors.where("quality is null"))):
            store.add(name, some, "label", "embedding")
        near = store.nearest(vectors, "vec_id", "embedding")
        return reliable(near.select("vec_id", F.col("class").cast("int").alias("label"), R6("distance").alias("distance")))


def tfidf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of pages by their URLs alone, with a classifier that was trained on labelled documents, kept and loaded; unsure ones by the path."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(labelled) if labelled.count() <= MOST_IDS else labelled, "doc_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    with _folder(spark) as path:
        tfidf.train(docs, "doc_id", "lang").save(path)
        found = tfidf.predict(tfidf.TfIdfModel.load(spark, path), pages, "page_id")
        told = F.regexp_extract("text", "/(en|de|fr|es)/", 1)
        other = pages.select("page_id", F.when(told != "", told).alias("class"))
        return reliable(tfidf.with_fallback(found, other, "page_id", 0.5).withColumn("probability", R6("probability")))


# ---- what evidence leaves uncovered ----

TERMS = ["the ", "und ", " de "]


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", F.explode(I.line_spans(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end", "s.line")
    spans = [docs.select("doc_id", F.explode(T.positions(F.col("text"), t)).alias("p")).select("doc_id", F.col("p").cast("long").alias("start"), (F.col("p").cast("long") + len(t)).alias("end")) for t in TERMS]
    return lines, spans[0].unionByName(spans[1]).unionByName(spans[2])


def outer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, how many lines no occurrence of a term touches, and their characters."""
    lines, evidence = _lines(spark, sf_dir)
    outer = I.uncovered(lines, evidence, "doc_id")
    return outer.groupBy("doc_id").agg(F.count("*").alias("n_outer"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))


def outer_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of words that only lines without evidence have, and whether they go back to the rules; the benchmark's words stand for rules."""
    lines, evidence = _lines(spark, sf_dir)
    # words are kept in one string, which takes much less room than an array
    kept = reliable(I.marked(lines, evidence, "doc_id").select("doc_id", "start", "covered", F.array_join(_words(F.col("line")), " ").alias("words")))
    whole = kept.where("words <> ''").select("doc_id", "start", "covered", F.split("words", " ").alias("terms"))
    outer = whole.where("not covered")
    single = reliable(I.outer_terms(whole.where("covered"), outer))
    pairs = I.outer_pairs(outer, single.select("term"), ["doc_id", "start"]).distinct()
    nodes = single.select(F.array("term").alias("terms"), "cross_confidence", "confidence").unionByName(pairs)
    rules = table(spark, sf_dir, "benchmark").select(F.explode(_words(F.col("text"))).alias("term"))
    return I.regression(nodes, rules).select(F.array_join("terms", " ").alias("terms"), "overlap", R6("confidence").alias("confidence"), "action", "target")


def quantified_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints over customers and orders: how many pairs break each, and the first of them."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    customers, orders = Q.Sort(c, "c_custkey"), Q.Sort(o, "o_orderkey")
    return Q.check([
        Q.numeric("machinery has credit", customers, c.c_mktsegment == "MACHINERY", c.c_acctbal, ">=", 0.0),
        Q.ForAll("debtors order little", customers, c.c_acctbal < 0, o.o_totalprice <= 400000, orders, {"c_custkey": "o_custkey"}),
        Q.ForAll("no order is free", orders, o.o_orderstatus.isNotNull(), o.o_totalprice > 0),
        Q.Exists("everyone rich has an urgent order", customers, c.c_acctbal > 5000, o.o_orderpriority == "1-URGENT", orders, {"c_custkey": "o_custkey"}),
    ])


# ---- values extracted from contracts, whose texts are made from orders ----

WARRANTY = Rule("warranty", "numeric_comparison", {"label": "保修期限", "context_pattern": "保修", "operator": ">=", "expected": 4, "unit": "年", "legal_ref": ""})
PENALTY = Rule("penalty", "numeric_comparison", {"label": "违约金", "context_pattern": "违约", "operator": "<=", "expected": 20, "unit": "%", "legal_ref": ""})


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each order as a contract with a warranty of as many years as it has items, and a penalty of its summed discount in percent."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").cast("string").alias("years"), F.round(F.sum("l_discount") * 100).cast("long").cast("string").alias("rate"))
    return lines.select("doc_id", F.concat(F.lit("第一条 本工程保修期限为"), "years", F.lit("年。第二条 违约金不得超过"), "rate", F.lit("%。")).alias("text"))


def extract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts by two numeric rules, with the values that sentences state."""
    return B.validate_rows_with_extraction(contracts(spark, sf_dir), [WARRANTY, PENALTY]).select("doc_id", "rule_id", "status", "value", "unit")


QUERIES = {f.__name__: f for f in (learner_signals, learner_weights, cluster_match, prototype_store, prototype_store_classify, running_centroids, tfidf_predict, outer_spans, outer_regression, quantified_orders, extract_validate)}

# ---- the same in SQL ----

_GRAMS = "list_transform(range(1, length(s)), lambda i: substr(s, i, 2))"
_LETTERS = "regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g')"
_EVENTS = """ev AS MATERIALIZED (SELECT event_id AS ev_id, ts, 'u' || user_id AS text_hash, event_type AS clause_type, value > 10 AS failed, value / 100 < 0.5 AS near, k, ['k' || k % 10, 'k' || k // 10, 'k' || (k * 7) % 10] AS terms,
        list_transform([k % 10, k // 10, (k * 7) % 10], lambda d: ['click', 'view', 'purchase', 'signup', 'error'][d % 5 + 1]) AS gs FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
    best AS (SELECT *, list_aggregate(gs, 'mode') AS g FROM ev),
    by_terms AS (SELECT *, len(list_filter(gs, lambda x: x = g)) AS c FROM best),
    a AS (SELECT ev_id, ts, text_hash, clause_type AS old_label, g AS suggested, least(0.85, 0.5 + c / 3 * 0.5) AS confidence, 'terms' AS signal, k = 5 AS given, terms FROM by_terms WHERE failed AND c >= 2 AND g <> clause_type),
    told AS (SELECT *, CASE WHEN given THEN 0 ELSE row_number() OVER (PARTITION BY text_hash, old_label, suggested, given ORDER BY ts, ev_id) END AS times FROM a)"""
_COUNTS = ", ".join(f"count(*) FILTER (clause_type = '{t}') OVER w AS n{i}" for i, t in enumerate(TYPES))
_LIST = "list_sort(list_filter([" + ", ".join(f"struct_pack(k := -n{i}, t := '{t}')" for i, t in enumerate(TYPES)) + "], lambda x: x.k < 0))"
_CENTROID = """(SELECT c, list(x ORDER BY i) AS v FROM (SELECT {0} AS c, i, avg(embedding[i]::DOUBLE) AS x FROM {1}, unnest(range(1, len(embedding) + 1)) t(i) WHERE {0} IS NOT NULL AND {0} <> -1 GROUP BY 1, 2) GROUP BY c)"""
_COS = "coalesce(list_sum(list_transform(range({1}, {2} + 1), lambda i: {0}[i] * q[i])) / nullif(sqrt(list_sum(list_transform(range({1}, {2} + 1), lambda i: {0}[i] * {0}[i])) * list_sum(list_transform(range({1}, {2} + 1), lambda i: q[i] * q[i]))), 0), 0)"
_HYBRID = "greatest(0, 1 - (0.3 * " + _COS.format("p", 1, 6) + " + 0.2 * " + _COS.format("p", 7, 10) + " + 0.5 * " + _COS.format("p", 1, "len(p)") + "))"
_BASE = f"""lab AS (SELECT d.doc_id, d.lang, d.text, l.quality FROM documents d JOIN labels l USING (doc_id)),
    grams AS MATERIALIZED (SELECT DISTINCT CASE lang WHEN 'fr' THEN 'es' ELSE lang END AS domain, gram FROM (SELECT lang, unnest({_GRAMS}) AS gram FROM (SELECT lang, {_LETTERS} AS s FROM lab))),
    doms AS (SELECT CASE lang WHEN 'fr' THEN 'es' ELSE lang END AS domain, count(*) AS samples, count(*) AS uses, count(*) FILTER (quality = 1) AS passed FROM lab GROUP BY 1),
    sized AS (SELECT domain, samples, coalesce(size, 0) AS size, CASE WHEN samples > 1 AND coalesce(size, 0) > 1 THEN 0.005 ELSE 0.01 END::DOUBLE AS threshold, uses, round(passed / uses, 3) AS pass_rate FROM doms LEFT JOIN (SELECT domain, count(*) AS size FROM grams GROUP BY 1) USING (domain))"""
_LINES = """doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nr FROM doc),
    spans AS MATERIALIZED (SELECT doc_id, line, "end" - length(line) AS start, "end" FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nr) - 1 AS "end" FROM cut) WHERE trim(line) <> ''),
    piece AS (SELECT doc_id, t, unnest(string_split(text, t)) AS p, unnest(range(1, len(string_split(text, t)) + 1)) AS nr FROM doc, (SELECT unnest(['the ', 'und ', ' de ']) AS t) WHERE contains(text, t)),
    ev AS MATERIALIZED (SELECT doc_id, stop - length(t) AS start, stop AS "end" FROM (SELECT doc_id, t, sum(length(p) + length(t)) OVER (PARTITION BY doc_id, t ORDER BY nr) AS stop, nr, count(*) OVER (PARTITION BY doc_id, t) AS n FROM piece) WHERE nr < n),
    hit AS MATERIALIZED (SELECT *, EXISTS (SELECT 1 FROM ev WHERE ev.doc_id = spans.doc_id AND ev.start < spans."end" AND spans.start < ev."end") AS covered FROM spans)"""
_WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: length(w) >= 3)"
_TF = """SELECT {0}, gram, 1 + ln(count(*)) AS tf FROM (SELECT {0}, unnest(list_concat(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)), list_transform(range(1, length(s)), lambda i: substr(s, i, 2)), list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) AS gram
        FROM (SELECT {0}, regexp_replace(lower(coalesce(text, '')), '\\s\\s+', ' ', 'g') AS s FROM {1})) GROUP BY ALL"""
ORACLES = {
    "learner_signals": f"""WITH {_EVENTS}, seen AS (SELECT *, {_COUNTS} FROM ev WINDOW w AS (PARTITION BY text_hash ORDER BY ts, ev_id)),
        ranked AS (SELECT *, {_LIST} AS l FROM seen),
        b AS (SELECT ev_id, text_hash, l[1].t AS old_label, l[2].t AS suggested FROM ranked WHERE len(l) > 1 AND list_sum(list_transform(l, lambda x: -x.k)) >= 3 AND -l[1].k / list_sum(list_transform(l, lambda x: -x.k)) < 0.67)
        SELECT ev_id, text_hash, old_label, suggested, round(confidence, 6) AS confidence, signal, times, times >= 2 AS accepted FROM told
        UNION ALL SELECT ev_id, text_hash, old_label, suggested, 0.55, 'inconsistent', 0, false FROM b
        UNION ALL SELECT ev_id, text_hash, clause_type, '', 0.45, 'boundary', 0, false FROM ev WHERE failed AND near""",
    "learner_weights": f"""WITH {_EVENTS}, moved AS (SELECT ts, ev_id, old_label AS label, false AS towards, terms FROM told WHERE times >= 2 UNION ALL SELECT ts, ev_id, suggested, true, terms FROM told WHERE times >= 2),
        each AS (SELECT ts, ev_id, label, towards, unnest(list_concat([''], terms)) AS gram, unnest(range(1, 5)) AS place FROM moved),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY label, gram ORDER BY ts DESC, ev_id DESC, place DESC) - 1 AS later FROM each),
        total AS (SELECT label, gram, count(*) AS n, sum({RATE} * CASE WHEN towards THEN {L.TO_TARGET} ELSE {L.FROM_TARGET} END * power({1 - RATE}::DOUBLE, later)) AS added, sum(CASE WHEN towards THEN 1 ELSE -1 END) AS net FROM ranked GROUP BY 1, 2),
        model AS (SELECT label, gram FROM (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS label), (SELECT unnest(list_concat([''], list_transform(range(10), lambda i: 'k' || i))) AS gram))
        SELECT label, gram, round(ln(CASE WHEN gram = '' THEN 0.2 + coalesce(net, 0) * {RATE * L.PRIOR_STEP} ELSE 0.05 * power({1 - RATE}::DOUBLE, coalesce(n, 0)) + coalesce(added, 0) END), 6) + 0.0 AS log_prob FROM model LEFT JOIN total USING (label, gram)""",
    "cluster_match": f"""WITH pt AS MATERIALIZED (SELECT e.vec_id, e.embedding, list_transform(e.embedding, lambda x: x::DOUBLE) AS p, CASE WHEN l.quality = 0 THEN -1 ELSE e.label END AS c, d.text FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
        first AS MATERIALIZED {_CENTROID.format("c", "pt")},
        noise AS (SELECT vec_id, min(struct_pack(d := {_HYBRID}, c := f.c)) AS m FROM pt, (SELECT c, v AS q FROM first) f WHERE pt.c = -1 GROUP BY vec_id),
        given AS MATERIALIZED (SELECT pt.* REPLACE (CASE WHEN m.d < 0.35 THEN m.c ELSE pt.c END AS c) FROM pt LEFT JOIN noise USING (vec_id)),
        mean AS MATERIALIZED {_CENTROID.format("c", "given")},
        top AS (SELECT c, list(gram ORDER BY place) AS tops FROM (SELECT c, gram, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, gram) AS place FROM (SELECT c, unnest(list_distinct({_GRAMS})) AS gram FROM (SELECT c, {_LETTERS} AS s FROM given WHERE c <> -1)) GROUP BY c, gram) WHERE place <= 5 GROUP BY c),
        described AS (SELECT *, printf('C_%03d', row_number() OVER (ORDER BY members DESC, c) - 1) AS cluster_id FROM (SELECT c, count(*) AS members FROM given WHERE c <> -1 GROUP BY c) JOIN mean USING (c) LEFT JOIN top USING (c)),
        named AS (SELECT c AS nearest, v AS q, cluster_id, members, CASE WHEN v[7] > 0.01 THEN '数字密集' ELSE '文本为主' END || '-' || coalesce(nullif(array_to_string(tops[:2], ''), ''), '未分类') || '-' || CASE WHEN v[1] < 0.3 THEN '前段' WHEN v[1] <= 0.7 THEN '中段' ELSE '后段' END AS label FROM described),
        best AS (SELECT vec_id, any_value(c) AS cluster, min(struct_pack(d := {_HYBRID}, c := nearest)) AS m FROM given, named GROUP BY vec_id)
        SELECT vec_id, cluster, cluster_id, members, label, round(m.d, 6) AS distance FROM best JOIN named ON nearest = m.c""",
    "prototype_store": f"WITH {_BASE} SELECT * FROM sized",
    "prototype_store_classify": f"""WITH {_BASE}, item AS (SELECT item_id, unnest(list_distinct({_GRAMS})) AS gram FROM (SELECT item_id, {_LETTERS} AS s FROM benchmark)),
        cov AS (SELECT item_id, domain, count(*) / any_value(n) AS c FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM item) JOIN grams USING (gram) GROUP BY 1, 2),
        ok AS (SELECT item_id, domain, c, row_number() OVER w AS place, lead(c) OVER w AS second FROM cov JOIN sized USING (domain) WHERE c >= threshold WINDOW w AS (PARTITION BY item_id ORDER BY c DESC, domain))
        SELECT item_id, domain, round(c, 6) AS coverage FROM (SELECT *, max(CASE WHEN place = 1 THEN c >= 2 * coalesce(second, 0) END) OVER (PARTITION BY item_id) AS alone FROM ok) WHERE place = 1 OR NOT alone""",
    "running_centroids": f"""WITH mean AS MATERIALIZED {_CENTROID.format("label", "embeddings")}, pt AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS p FROM embeddings)
        SELECT vec_id, m.c AS label, round(m.d, 6) AS distance FROM (SELECT vec_id, min(struct_pack(d := {_HYBRID}, c := c)) AS m FROM pt, (SELECT c, v AS q FROM mean) GROUP BY vec_id)""",
    "tfidf_predict": f"""WITH doc AS MATERIALIZED (SELECT d.* FROM documents d JOIN labels l USING (doc_id)), tf AS MATERIALIZED ({_TF.format("doc_id, lang", "doc")}),
        idf AS MATERIALIZED (SELECT gram, ln((1 + (SELECT count(*) FROM doc)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram HAVING count(*) <= 0.95 * (SELECT count(*) FROM doc)),
        w AS MATERIALIZED (SELECT doc_id, lang, gram, tf * idf AS w FROM tf JOIN idf USING (gram)), sums AS MATERIALIZED (SELECT lang, gram, sum(w / norm) AS s FROM w JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
        cls AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM doc)) AS prior, -ln((SELECT sum(s) FROM sums WHERE sums.lang = doc.lang) + (SELECT count(*) FROM idf)) AS base FROM doc GROUP BY lang),
        item AS (SELECT page_id, url AS text FROM pages), itf AS ({_TF.format("page_id", "item")}), iw AS MATERIALIZED (SELECT page_id, gram, tf * idf AS w FROM itf JOIN idf USING (gram)),
        x AS MATERIALIZED (SELECT page_id, gram, w / norm AS x FROM iw JOIN (SELECT page_id, sqrt(sum(w * w)) AS norm FROM iw GROUP BY 1) USING (page_id)),
        score AS (SELECT page_id, lang, prior + coalesce(total, 0) * base + coalesce(lifted, 0) AS s FROM item CROSS JOIN cls LEFT JOIN (SELECT page_id, sum(x) AS total FROM x GROUP BY 1) USING (page_id)
            LEFT JOIN (SELECT page_id, lang, sum(x * ln(s + 1)) AS lifted FROM x JOIN sums USING (gram) GROUP BY 1, 2) USING (page_id, lang)),
        prob AS (SELECT page_id, lang, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY page_id) AS pr FROM (SELECT *, max(s) OVER (PARTITION BY page_id) AS m FROM score)),
        top AS (SELECT page_id, arg_max(lang, pr) AS lang, max(pr) AS pr FROM prob GROUP BY 1), told AS (SELECT page_id, nullif(regexp_extract(text, '/(en|de|fr|es)/', 1), '') AS told FROM item)
        SELECT page_id, CASE WHEN pr < 0.5 AND told IS NOT NULL THEN told ELSE lang END AS class, round(pr, 6) AS probability, CASE WHEN pr < 0.5 AND told IS NOT NULL THEN 'fallback' ELSE 'model' END AS source FROM top JOIN told USING (page_id)""",
    "outer_spans": f"WITH {_LINES} SELECT doc_id, count(*) AS n_outer, sum(\"end\" - start)::BIGINT AS n_chars FROM hit WHERE NOT covered GROUP BY doc_id",
    "outer_regression": f"""WITH {_LINES}, t AS MATERIALIZED (SELECT doc_id, start, covered, {_WORDS.format("line")} AS w FROM hit),
        words AS (SELECT covered, unnest(w) AS term FROM t), single AS MATERIALIZED (SELECT term, count(*) AS n FROM words WHERE NOT covered GROUP BY term HAVING count(*) >= 2 AND term NOT IN (SELECT term FROM words WHERE covered)),
        pos AS (SELECT doc_id, start, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM t WHERE NOT covered), flag AS MATERIALIZED (SELECT pos.*, s.term IS NOT NULL AS lone FROM pos LEFT JOIN single s USING (term)),
        pair AS (SELECT DISTINCT p[1] AS a, p[2] AS b FROM (SELECT arg_min([x.term, y.term], (x.i, y.i)) AS p FROM flag x JOIN flag y ON x.doc_id = y.doc_id AND x.start = y.start AND y.i BETWEEN x.i + 1 AND x.i + 4 WHERE x.lone OR y.lone GROUP BY x.doc_id, x.start)),
        node AS (SELECT [term] AS terms, least(0.5, n / 10) AS cross, least(0.6, n / 8) AS sure FROM single UNION ALL SELECT [a, b], 0.3, 0.25 FROM pair),
        rule AS (SELECT list_distinct(list(r)) AS r FROM (SELECT unnest({_WORDS.format("text")}) AS r FROM benchmark)),
        judged AS (SELECT *, len(known) / greatest(len(list_distinct(terms)), 1) AS overlap FROM (SELECT terms, "cross", sure, list_sort(list_intersect(terms, r)) AS known FROM node, rule))
        SELECT array_to_string(terms, ' ') AS terms, overlap, round(sure, 6)::DOUBLE AS confidence, CASE WHEN overlap >= 0.8 AND "cross" >= 0.3 THEN 'correct_rule' WHEN sure >= 0.5 AND overlap >= 0.5 THEN 'upgrade_to_conjecture' WHEN "cross" >= 0.6 THEN 'new_rule' ELSE 'keep_outer' END AS action,
            CASE WHEN overlap >= 0.8 AND "cross" >= 0.3 THEN known[1] END AS target FROM judged""",
    "extract_validate": """WITH l AS (SELECT l_orderkey AS doc_id, count(*)::DOUBLE AS years, round(sum(l_discount) * 100)::DOUBLE AS rate FROM lineitem GROUP BY 1)
        SELECT doc_id, 'warranty' AS rule_id, CASE WHEN years >= 4 THEN 'PASSED' ELSE 'FAILED' END AS status, years AS value, '年' AS unit FROM l
        UNION ALL SELECT doc_id, 'penalty', CASE WHEN rate <= 20 THEN 'PASSED' ELSE 'FAILED' END, rate, '%' FROM l""",
    "quantified_orders": """WITH broken AS (
            SELECT 'machinery has credit' AS c, c_custkey::VARCHAR AS s, NULL::VARCHAR AS w FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0
            UNION ALL SELECT 'debtors order little', c_custkey::VARCHAR, o_orderkey::VARCHAR FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_totalprice > 400000
            UNION ALL SELECT 'no order is free', o_orderkey::VARCHAR, NULL FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice <= 0
            UNION ALL SELECT 'everyone rich has an urgent order', c_custkey::VARCHAR, NULL FROM customer WHERE c_acctbal > 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))
        SELECT n AS "constraint", count(c) = 0 AS holds, count(c) AS broken_by, min((s, w))[1] AS subject, min((s, w))[2] AS witness
        FROM (SELECT unnest(['machinery has credit', 'debtors order little', 'no order is free', 'everyone rich has an urgent order']) AS n) LEFT JOIN broken ON c = n GROUP BY n""",
}
