"""Queries on clauses, contracts and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clauses as C
from ..operators.rules import Rule, evaluate
from .inline import frame, values
from .rule_queries import docs

CONTRACTS = [
    (1, "甲方：某公司\n乙方：某公司\n第一条 工程概况\n工程名称：某大楼。\n第二条 付款方式\n进度款支付至70%。\n  \n三、违约责任\n逾期每日万分之五。\n（一）争议解决\n提交仲裁。"),
    (2, "没有条款的文本。\n第二行。"),
    (3, "# 合同一\n保修五年。\n# 合同二\n工期30天。"),
    (4, "前言文字\n# 合同\n第1条 安全\n事故防护。"),
    (5, ""),
    (6, "第一章 总则\n1. 定义\n第 二 条 验收\n竣工验收。"),
]
CLAUSES = [
    (1, 0, "头部", "头部", "甲方：某公司\n乙方：某公司"), (1, 1, "第一条", "工程概况", "第一条 工程概况\n工程名称：某大楼。"), (1, 2, "第二条", "付款", "第二条 付款方式\n进度款支付至70%。"), (1, 3, "三、", "违约", "三、违约责任\n逾期每日万分之五。"), (1, 4, "（一）", "争议", "（一）争议解决\n提交仲裁。"),
    (2, 0, "全文", "其他", "没有条款的文本。\n第二行。"), (3, 0, "全文", "保修", "# 合同一\n保修五年。\n# 合同二\n工期30天。"), (4, 0, "头部", "头部", "前言文字\n# 合同"), (4, 1, "第1条", "安全", "第1条 安全\n事故防护。"),
    (6, 0, "第一章", "其他", "第一章 总则\n1. 定义"), (6, 1, "第 二 条", "验收", "第 二 条 验收\n竣工验收。"),
]
SEGMENTS = [
    (1, 0, "全文", CONTRACTS[0][1]), (2, 0, "全文", CONTRACTS[1][1]), (3, 1, "合同一", "# 合同一\n保修五年。\n# 合同二"), (3, 2, "合同二", "# 合同二\n工期30天。"),
    (4, 0, "前言/无标题", "前言文字"), (4, 1, "合同", "# 合同\n第1条 安全\n事故防护。"), (6, 0, "全文", CONTRACTS[5][1]),
]


def _contracts(spark: SparkSession) -> DataFrame:
    return frame(spark, CONTRACTS, "doc_id long, text string")


def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_clauses(_contracts(spark)).select("doc_id", F.col("clause_ix").cast("long").alias("clause_ix"), "clause_id", "clause_type", "content")


def contract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_contracts(_contracts(spark)).select("doc_id", F.col("segment_ix").cast("long").alias("segment_ix"), "title", "text")


def clause_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on clauses of one type is evaluated on those only, and not applicable without any."""
    rule = Rule("pay", "required_pattern", {"terms": ["进度款"]}, clause_type="付款")
    texts = _contracts(spark)
    own = C.scoped(C.split_clauses(texts)).where(F.col("clause_type") == rule.clause_type).select("doc_id", "scope")
    found = evaluate(own, [rule], text_col="scope").select("doc_id", "status")
    return texts.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("NOT_APPLICABLE")).alias("status"))


def lines_as_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines that aren't blank, as clauses of level 1."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("clause_ix", "content")).where("trim(content) <> ''").select("doc_id", "clause_ix", F.substring("content", 1, 20).alias("clause_title"), "content", F.lit(1).alias("level"))


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["position", "chars", "lines", "level", "marker", "avg_line", "digits", "numbers", "cn", "pct", "han", "punct", "distinct_chars", "variation"]
    out = C.features(lines_as_clauses(spark, sf_dir))
    return out.select("doc_id", F.col("clause_ix").cast("long").alias("clause_ix"), *(F.round(F.col("features")[i], 6).alias(k) for i, k in enumerate(names)))


def annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, snippet and heading of the first occurrence of a word in each document that has it."""
    found = docs(spark, sf_dir).where(F.col("text").contains("tion"))
    at = F.locate("tion", F.col("text")) - 1
    return found.select("doc_id", C.annotate(F.col("text"), at).alias("a")).select("doc_id", F.col("a.line").cast("long").alias("line"), "a.snippet")


QUERIES = {"clause_split": clause_split, "contract_split": contract_split, "clause_gate": clause_gate, "feature_vector": feature_vector, "source_annotation": annotate}
ORACLES = {
    "clause_split": "SELECT * FROM " + values(CLAUSES, "doc_id", "clause_ix", "clause_id", "clause_type", "content"),
    "contract_split": "SELECT * FROM " + values(SEGMENTS, "doc_id", "segment_ix", "title", "text"),
    "clause_gate": "SELECT doc_id, CASE WHEN doc_id = 1 THEN 'PASSED' ELSE 'NOT_APPLICABLE' END AS status FROM " + values([(r[0],) for r in CONTRACTS], "doc_id"),
    "source_annotation": """
        SELECT doc_id, length(regexp_replace(substr(text, 1, p), '[^\n]', '', 'g')) + 1 AS line,
               CASE WHEN p > 50 THEN '...' ELSE '' END || substr(text, greatest(p - 50, 0) + 1, least(p + 50, length(text)) - greatest(p - 50, 0)) || CASE WHEN p + 50 < length(text) THEN '...' ELSE '' END AS snippet
        FROM (SELECT *, instr(text, 'tion') - 1 AS p FROM documents WHERE contains(text, 'tion'))""",
    "feature_vector": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS clause_ix FROM documents),
        c AS (SELECT *, length(content)::DOUBLE AS n, greatest(length(content), 1)::DOUBLE AS per FROM l WHERE trim(content) <> '')
        SELECT doc_id, clause_ix, round(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY clause_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(sum(n) OVER (PARTITION BY doc_id), 1), 6) AS position,
               round(n / max(n) OVER (PARTITION BY doc_id), 6) AS chars, 1.0::DOUBLE AS lines, round(1 / 3.0::DOUBLE, 6) AS level,
               CASE WHEN regexp_matches(substr(content, 1, 20), '^\d+\s*[.、]') THEN 0.66 ELSE 0.0 END::DOUBLE AS marker,
               round(least(length(regexp_replace(content, '^\s+|\s+$', '', 'g')) / 200.0::DOUBLE, 1), 6) AS avg_line,
               round(len(regexp_extract_all(content, '[0-9]')) / per, 6) AS digits, round(least(len(regexp_extract_all(content, '[0-9]+(?:\.[0-9]+)?')) / 30.0::DOUBLE, 1), 6) AS numbers,
               0.0::DOUBLE AS cn, round(least(len(regexp_extract_all(content, '[%％]')) / 10.0::DOUBLE, 1), 6) AS pct, 0.0::DOUBLE AS han,
               round(len(regexp_extract_all(content, '[，。；：、！？,.;:!?()（）]')) / per, 6) AS punct,
               round(len(list_distinct(string_split(content, ''))) / per, 6) AS distinct_chars, 0.0::DOUBLE AS variation
        FROM c""",
}
