"""Queries on rules: every condition type, gates, and the evidence pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import text as T
from ..operators import evidence as E
from ..operators.rules import Rule, evaluate, judged
from .inline import CJK_TEXTS, frame, values

TOKENS = "regexp_split_to_array(lower(text), '[^a-z0-9_]+')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _status(rule: Rule):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate(docs(spark, sf_dir).select("doc_id", "text"), [rule])
        return out.select("doc_id", "status", F.array_join("matched_terms", ",").alias("matched"))

    return query


def _has(term: str) -> str:
    return f"list_contains({TOKENS}, '{term}')"


def _matched(*terms: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(t)} THEN '{t}' END" for t in terms) + ")"


RULES = {
    "mutual_exclusion": Rule("r1", "mutual_exclusion", {"terms": ["the", "que", "und"], "threshold": 2}),
    "co_occurrence": Rule("r2", "co_occurrence", {"antecedent": "the", "consequent": "with"}),
    "forbidden_pattern": Rule("r3", "forbidden_pattern", {"terms": ["license", "password", "token"]}),
    "required_pattern": Rule("r4", "required_pattern", {"terms": ["and", "und", "et"]}),
    "logical_chain": Rule("r5", "logical_chain", {"premises": ["the", "of"], "conclusion": "from"}),
    "scope_constraint": Rule("r6", "scope_constraint", {"scope": "der die", "delegate": {"condition_type": "co_occurrence", "params": {"antecedent": "der", "consequent": "zu"}}}),
    "contextual_co_occurrence": Rule("r9", "contextual_co_occurrence", {"term_a": "tion", "term_b": "the", "window_chars": 30, "min_occurrences": 3}),
    "definition_contains": Rule("r10", "definition_contains", {"concept": "tion", "required_terms": ["the", "and", "of"], "window_chars": 50, "min_ratio": 0.6}),
    "topic_coverage": Rule("r11", "topic_coverage", {"source_keywords": ["the", "est", "und", "que", "tion"], "min_coverage_ratio": 0.5}),
    "term_coverage_check": Rule("r12", "term_coverage_check", {"entity_groups": {"en": ["the", "and"], "de": ["und", "der"], "fr": ["les", "est"]}, "min_entity_groups_present": 2}),
    "ast_check": Rule("r13", "ast_check", {"language": "javascript"}),
    "unknown_condition": Rule("r14", "no_such_type"),
}
_AT = "(SELECT doc_id, text, unnest(list_transform(range(1, length(lower(text)) + 1), lambda i: CASE WHEN substr(lower(text), i, 4) = 'tion' THEN i END)) AS p FROM documents)"
SQL = {
    "mutual_exclusion": f"SELECT doc_id, CASE WHEN {_has('the')}::INT + {_has('que')}::INT + {_has('und')}::INT >= 2 THEN 'FAILED' ELSE 'PASSED' END AS status, {_matched('the', 'que', 'und')} AS matched FROM documents",
    "co_occurrence": f"SELECT doc_id, CASE WHEN {_has('the')} AND NOT {_has('with')} THEN 'FAILED' ELSE 'PASSED' END AS status, {_matched('the', 'with')} AS matched FROM documents",
    "forbidden_pattern": f"""
        WITH t AS (SELECT doc_id, {_matched("license", "password", "token")} AS words,
                   concat_ws(',', CASE WHEN contains(text, 'license') THEN 'license' END, CASE WHEN contains(text, 'password') THEN 'password' END, CASE WHEN contains(text, 'token') THEN 'token' END) AS parts FROM documents)
        SELECT doc_id, CASE WHEN words <> '' OR parts <> '' THEN 'FAILED' ELSE 'PASSED' END AS status, CASE WHEN words <> '' THEN words ELSE parts END AS matched FROM t""",
    "required_pattern": f"SELECT doc_id, CASE WHEN {_has('and')} OR {_has('und')} OR {_has('et')} THEN 'PASSED' ELSE 'FAILED' END AS status, {_matched('and', 'und', 'et')} AS matched FROM documents",
    "logical_chain": f"SELECT doc_id, CASE WHEN {_has('the')} AND {_has('of')} AND NOT {_has('from')} THEN 'FAILED' ELSE 'PASSED' END AS status, CASE WHEN {_has('the')} AND {_has('of')} AND NOT {_has('from')} THEN 'the,of' ELSE {_matched('the', 'of', 'from')} END AS matched FROM documents",
    "scope_constraint": f"SELECT doc_id, CASE WHEN NOT ({_has('der')} OR {_has('die')}) THEN 'NOT_APPLICABLE' WHEN {_has('der')} AND NOT {_has('zu')} THEN 'FAILED' ELSE 'PASSED' END AS status, CASE WHEN NOT ({_has('der')} OR {_has('die')}) THEN '' ELSE {_matched('der', 'zu')} END AS matched FROM documents",
    "contextual_co_occurrence": f"""
        WITH o AS (SELECT doc_id, contains(substr(lower(text), greatest(p - 30, 1), p + 34 - greatest(p - 30, 1)), 'the') AS near FROM {_AT} WHERE p IS NOT NULL),
        n AS (SELECT doc_id, count(*) FILTER (near) AS k FROM o GROUP BY 1)
        SELECT doc_id, CASE WHEN k IS NULL THEN 'NOT_APPLICABLE' WHEN k >= 3 THEN 'PASSED' ELSE 'FAILED' END AS status, CASE WHEN k IS NULL THEN '' WHEN k >= 3 THEN 'tion,the' ELSE 'tion' END AS matched
        FROM documents LEFT JOIN n USING (doc_id)""",
    "definition_contains": f"""
        WITH o AS (SELECT doc_id, substr(lower(text), greatest(p - 50, 1), p + 54 - greatest(p - 50, 1)) AS s FROM {_AT} WHERE p IS NOT NULL),
        n AS (SELECT doc_id, max((contains(s, 'the')::INT + contains(s, 'and')::INT + contains(s, 'of')::INT) / 3.0) AS k FROM o GROUP BY 1)
        SELECT doc_id, CASE WHEN k IS NULL THEN 'NOT_APPLICABLE' WHEN k >= 0.6 THEN 'PASSED' ELSE 'FAILED' END AS status, CASE WHEN k IS NULL THEN '' ELSE 'tion' END AS matched
        FROM documents LEFT JOIN n USING (doc_id)""",
    "topic_coverage": "WITH k AS (SELECT doc_id, list_filter(['the', 'est', 'und', 'que', 'tion'], lambda t: contains(lower(text), t)) AS m FROM documents) SELECT doc_id, CASE WHEN len(m) / 5.0 >= 0.5 THEN 'PASSED' ELSE 'FAILED' END AS status, array_to_string(m, ',') AS matched FROM k",
    "term_coverage_check": "WITH k AS (SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'the') OR contains(text, 'and') THEN 'en' END, CASE WHEN contains(text, 'und') OR contains(text, 'der') THEN 'de' END, CASE WHEN contains(text, 'les') OR contains(text, 'est') THEN 'fr' END) AS m FROM documents) SELECT doc_id, CASE WHEN len(string_split(m, ',')) >= 2 THEN 'PASSED' ELSE 'FAILED' END AS status, m AS matched FROM k",
    "ast_check": "SELECT doc_id, 'PASSED' AS status, '' AS matched FROM documents",
    "unknown_condition": "SELECT doc_id, 'NOT_APPLICABLE' AS status, '' AS matched FROM documents",
}

# ---- the same conditions on Chinese texts: expected verdicts are stated ----

CJK_CASES = [
    (Rule("保修书", "required_pattern", {"terms": ["质量保修书"]}), {1: "PASSED", 2: "FAILED", 3: "FAILED", 4: "FAILED", 5: "FAILED", 6: "FAILED", 7: "FAILED", 8: "FAILED", 9: "FAILED", 10: "FAILED"}),
    (Rule("协商", "required_pattern", {"terms": ["协商"]}), {3: "PASSED"}),
    (Rule("转包", "forbidden_pattern", {"terms": ["转包"]}), {4: "PASSED", 5: "FAILED", 1: "PASSED"}),
    (Rule("保修期限", "numeric_comparison", {"label": "保修期限", "context_pattern": "保修期限", "unit": "年", "operator": ">=", "expected": 5}), {1: "PASSED", 2: "FAILED", 3: "NOT_APPLICABLE"}),
    (Rule("保证金", "numeric_comparison", {"label": "质量保证金", "context_pattern": "质量保证金", "unit": "%", "operator": "<=", "expected": 3}), {10: "FAILED", 6: "NOT_APPLICABLE"}),
    (Rule("比例", "sum_numeric_comparison", {"label": "付款", "context_pattern": "预付款|进度款", "unit": "%", "operator": "<=", "expected": 100}), {6: "FAILED", 1: "NOT_APPLICABLE"}),
    (Rule("工期", "numeric_comparison", {"label": "工期", "context_pattern": "工期", "unit": "天", "operator": "<=", "expected": 100}), {7: "FAILED"}),
    (Rule("违约金", "numeric_comparison", {"label": "违约金", "context_pattern": "违约金", "unit": "%", "operator": "<=", "expected": 0.1}), {8: "PASSED", 6: "FAILED"}),
]


def cjk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of rules on Chinese texts, where an expected one is stated."""
    stated = frame(spark, [(i, r.id, v) for r, want in CJK_CASES for i, v in want.items()], "doc_id long, rule_id string, expected string")
    found = evaluate(frame(spark, CJK_TEXTS, "doc_id long, text string"), [r for r, _ in CJK_CASES])
    return found.join(F.broadcast(stated), ["doc_id", "rule_id"]).select("doc_id", "rule_id", "status")


NUMERALS = ["十五", "三百", "一千二百", "二十四", "两万", "12", "零", "亿", "百", "七十", "三五", "abc", "一万零五"]


def numeral_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, [(s,) for s in NUMERALS], "s string").select("s", N.numeral(F.col("s")).alias("value"), N.numeral(F.col("s"), adding=True).alias("added"))


_NUMERAL_VALUES = [15, 300, 1200, 24, 20000, 12, None, None, 100, 70, 5, None, 10005]
_NUMERAL_ADDED = [15, 300, 1200, 24, 20000, 12, None, None, 100, 70, 8, None, 10005]


def contract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, CJK_TEXTS, "id long, text string").select("id", N.contract_value(F.col("text")).alias("value"))


def chinese_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 0 to 29 (of which 1 and more have a numeral) and back."""
    return spark.range(30).select("id", N.to_chinese(F.col("id").cast("int")).alias("s")).select("id", F.coalesce(N.numeral(F.col("s")), F.lit(0).cast("long")).alias("back"))


def tokens_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = T.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", toks.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.let(T.tokens(F.col("text")), lambda t: F.size(T.token_ngrams(t))).cast("long").alias("n"))


def cjk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, CJK_TEXTS, "id long, text string").select("id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"), F.size(T.han_ngrams(F.col("text"), 1, 3)).cast("long").alias("grams"), F.size(T.bigrams(F.col("text"))).cast("long").alias("bigrams"))


# ---- gates and the evidence pipeline ----

PACKAGE = [
    Rule("p1", "required_pattern", {"terms": ["the"]}, package_id="a", severity="error", category="en"),
    Rule("p2", "forbidden_pattern", {"terms": ["the"]}, package_id="b", severity="warning", category="en"),
    Rule("p3", "co_occurrence", {"antecedent": "und", "consequent": "der"}, package_id="a", severity="info", category="de", exclude_contract_types=("src0", "src1")),
    Rule("p1", "required_pattern", {"terms": ["and"]}, package_id="b", severity="error", category="en"),
    Rule("p4", "mutual_exclusion", {"terms": ["de", "la"]}, package_id="a", severity="warning", category="fr", min_contract_value=1000.0),
]


def package_evidence(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence of a small package; sources act as contract types and lengths as values."""
    return evaluate(docs(spark, sf_dir), PACKAGE, contract_type=F.col("source"), value=F.col("n_chars").cast("double"), keep=keep)


def package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as one row for each document."""
    return judged(docs(spark, sf_dir), PACKAGE, contract_type=F.col("source"), value=F.col("n_chars").cast("double"))


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_evidence(spark, sf_dir).select("doc_id", "rule_ix", "rule_id", "package_id", "severity", "status")


def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merged_rows(package_verdicts(spark, sf_dir)).select("doc_id", "rule_id", "status", "rule_ix", F.array_join("matched_terms", ",").alias("matched"), F.length("input_fragment").cast("long").alias("fragment_chars"))


def evidence_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_n(E.without_warnings(package_evidence(spark, sf_dir)), 2).select("doc_id", "rule_ix", "rule_id", "status")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conflict_rows(package_verdicts(spark, sf_dir))


def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overall(package_evidence(spark, sf_dir))


def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rollup(package_evidence(spark, sf_dir, keep=("lang",)), "lang", "rule_id")


def rule_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per rule, per category and in all, in one aggregation."""
    rows = package_evidence(spark, sf_dir)
    out = rows.groupingSets([["rule_id"], ["category"], []], "rule_id", "category")
    return out.agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count("*").alias("total"))


def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values extracted beforehand (here: lengths, null for one language) decide a numeric rule."""
    base = docs(spark, sf_dir)
    rows = evaluate(base.select("doc_id", "text"), [Rule("len", "numeric_comparison", {"context_pattern": "工期", "unit": "天"})])
    given = base.select("doc_id", F.lit("len").alias("rule_id"), F.when(F.col("lang") != "de", F.col("n_chars").cast("double")).alias("value"), F.when(F.col("lang") == "fr", "<=").alias("operator_hint"), F.lit(0.5).alias("confidence"))
    limits = frame(spark, [("len", ">=", 2000.0)], "rule_id string, operator string, expected double")
    return E.inject(rows, given, limits).select("doc_id", "rule_id", "status")


_EV = f"""WITH e AS (
    SELECT doc_id, lang, 0 AS rule_ix, 'p1' AS rule_id, 'a' AS package_id, 'error' AS severity, 'en' AS category, CASE WHEN {_has("the")} THEN 'PASSED' ELSE 'FAILED' END AS status, {_matched("the")} AS matched, text FROM documents
    UNION ALL SELECT doc_id, lang, 1, 'p2', 'b', 'warning', 'en', CASE WHEN contains(text, 'the') OR {_has("the")} THEN 'FAILED' ELSE 'PASSED' END, CASE WHEN contains(text, 'the') OR {_has("the")} THEN 'the' ELSE '' END, text FROM documents
    UNION ALL SELECT doc_id, lang, 2, 'p3', 'a', 'info', 'de', CASE WHEN source IN ('src0', 'src1') THEN 'NOT_APPLICABLE' WHEN {_has("und")} AND NOT {_has("der")} THEN 'FAILED' ELSE 'PASSED' END, CASE WHEN source IN ('src0', 'src1') THEN '' ELSE {_matched("und", "der")} END, text FROM documents
    UNION ALL SELECT doc_id, lang, 3, 'p1', 'b', 'error', 'en', CASE WHEN {_has("and")} THEN 'PASSED' ELSE 'FAILED' END, {_matched("and")}, text FROM documents
    UNION ALL SELECT doc_id, lang, 4, 'p4', 'a', 'warning', 'fr', CASE WHEN n_chars > 0 AND n_chars < 1000 THEN 'NOT_APPLICABLE' WHEN {_has("de")} AND {_has("la")} THEN 'FAILED' ELSE 'PASSED' END, CASE WHEN n_chars > 0 AND n_chars < 1000 THEN '' ELSE {_matched("de", "la")} END, text FROM documents)"""
_COUNTS = "count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'NOT_APPLICABLE') AS not_applicable, count(*) AS total"
_CUT = "regexp_replace(substr(text, greatest(p - 100, 1), least(q + 99, length(text)) - greatest(p - 100, 1) + 1), '^\\s+|\\s+$', '', 'g')"
_FRAGMENTS = f""", places AS (
        SELECT *, CASE WHEN status = 'FAILED' AND rule_ix = 1 THEN [instr(lower(text), 'the')] WHEN status = 'FAILED' AND rule_ix = 2 THEN [instr(lower(text), 'und')]
                       WHEN status = 'FAILED' AND rule_ix = 4 THEN [instr(lower(text), 'de'), instr(lower(text), 'la')] END AS spots FROM e),
    f AS (SELECT * EXCLUDE (spots), CASE WHEN spots IS NULL THEN substr(text, 1, 200) ELSE
                 CASE WHEN p > 101 THEN '...' ELSE '' END || {_CUT} || CASE WHEN q + 99 < length(text) THEN '...' ELSE '' END END[1:500] AS fragment
          FROM (SELECT *, list_min(spots) AS p, list_max(spots) AS q FROM places))"""

QUERIES = {k: _status(r) for k, r in RULES.items()} | {
    "cjk_verdicts_inline": cjk_verdicts, "cn_number_parse_inline": numeral_parse, "contract_value_inline": contract_values, "cn_number_roundtrip": chinese_numbers,
    "tokens_latin": tokens_latin, "token_ngrams": token_ngrams, "cjk_windows_inline": cjk_windows,
    "evidence_union": evidence_union, "evidence_dedup": evidence_dedup, "evidence_top_n": evidence_top_n, "conflicts": conflicts, "overall_status": overall_status,
    "segment_rollup": segment_rollup, "rule_grouping_sets": rule_grouping_sets, "sidecar_injection": sidecar,
}
ORACLES = SQL | {
    "cjk_verdicts_inline": "SELECT * FROM " + values([(i, r.id, v) for r, want in CJK_CASES for i, v in want.items()], "doc_id", "rule_id", "status"),
    "cn_number_parse_inline": "SELECT * FROM " + values(list(zip(NUMERALS, _NUMERAL_VALUES, _NUMERAL_ADDED, strict=True)), "s", "value", "added"),
    "contract_value_inline": "SELECT * FROM " + values([(1, 5), (2, 3), (3, 0), (4, 0), (5, 3), (6, 100), (7, 1200000), (8, 3505000), (9, 0), (10, 0)], "id", "value"),
    "cn_number_roundtrip": "SELECT range AS id, range AS back FROM range(30)",
    "tokens_latin": f"SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, list_filter({TOKENS}, lambda x: x <> '') AS t FROM documents)",
    "token_ngrams": f"SELECT doc_id, (len(list_distinct(t)) + len(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) + len(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))))::BIGINT AS n FROM (SELECT doc_id, list_filter({TOKENS}, lambda x: x <> '') AS t FROM documents)",
    "cjk_windows_inline": "WITH t AS (SELECT * FROM " + values(CJK_TEXTS, "id", "text") + r"""), r AS (SELECT id, unnest(regexp_extract_all(lower(text), '[㐀-䶿一-鿿豈-﫿]+|[a-z0-9_]+')) AS run FROM t),
        w AS (SELECT id, sum(CASE WHEN regexp_matches(run, '^[a-z0-9_]') THEN 1 ELSE list_sum(list_transform(range(1, 7), lambda k: greatest(length(run) - k + 1, 0))) END)::BIGINT AS n FROM r GROUP BY id),
        h AS (SELECT id, regexp_replace(text, '[^一-鿿]', '', 'g') AS s FROM t)
        SELECT id, coalesce(n, 0) AS n, list_sum(list_transform(range(1, 4), lambda k: greatest(length(s) - k + 1, 0)))::BIGINT AS grams,
               len(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))) AS bigrams FROM h LEFT JOIN w USING (id)""",
    "evidence_union": _EV + " SELECT doc_id, rule_ix, rule_id, package_id, severity, status FROM e",
    "evidence_top_n": _EV + " SELECT doc_id, rule_ix, rule_id, status FROM e WHERE severity <> 'warning' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule_ix, status) <= 2",
    "conflicts": _EV + _FRAGMENTS + """
        SELECT a.doc_id, a.rule_id, b.rule_id AS rule_id_b, a.status, b.status AS status_b, CASE WHEN a.package_id = b.package_id THEN 'intra_package' ELSE 'cross_package' END AS conflict_type
        FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.fragment = b.fragment AND a.rule_ix < b.rule_ix AND a.status <> b.status""",
    "evidence_dedup": _EV + _FRAGMENTS + """
        , g AS (SELECT doc_id, rule_id, status, min(rule_ix) AS rule_ix, string_agg(DISTINCT CASE WHEN matched <> '' THEN matched END, ',' ORDER BY CASE WHEN matched <> '' THEN matched END DESC) AS matched, list(fragment ORDER BY rule_ix) AS fs FROM f GROUP BY ALL)
        SELECT doc_id, rule_id, status, rule_ix, coalesce(matched, '') AS matched,
               (CASE WHEN len(fs) = 1 OR contains(fs[1], fs[2]) THEN length(fs[1]) ELSE least(length(fs[1]), 300) + 5 + least(length(fs[2]), 200) END)::BIGINT AS fragment_chars FROM g""",
    "overall_status": _EV + " SELECT doc_id, CASE WHEN bool_or(status = 'FAILED') THEN 'CONFLICTED' ELSE 'VALIDATED' END AS status FROM e GROUP BY 1",
    "segment_rollup": _EV + f" SELECT lang, rule_id, {_COUNTS} FROM e GROUP BY ROLLUP (lang, rule_id)",
    "rule_grouping_sets": _EV + " SELECT rule_id, category, count(*) FILTER (status = 'FAILED') AS failed, count(*) AS total FROM e GROUP BY GROUPING SETS ((rule_id), (category), ())",
    "sidecar_injection": "SELECT doc_id, 'len' AS rule_id, CASE WHEN lang = 'de' THEN 'NOT_APPLICABLE' WHEN lang = 'fr' THEN CASE WHEN n_chars <= 2000 THEN 'PASSED' ELSE 'FAILED' END WHEN n_chars >= 2000 THEN 'PASSED' ELSE 'FAILED' END AS status FROM documents",
}
