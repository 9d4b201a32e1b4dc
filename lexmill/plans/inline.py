"""Small tables that queries and their SQL both spell out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_value(x) for x in v) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else (f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT")


def values(rows: list[tuple], *names: str) -> str:
    """A FROM item in SQL with these rows."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_value(v) for v in r) + ")" for r in rows) + ") AS v(" + ", ".join(names) + "))"


CJK_TEXTS = [
    (1, "保修期限为五年，承包人应当提供质量保修书。"),
    (2, "保修期限为三年。本合同不另行签订质量保修书。"),
    (3, "双方协商不成的，提交仲裁委员会仲裁。"),
    (4, "不得转包，禁止违法分包。"),
    (5, "承包人可以将工程转包给第三方。"),
    (6, "违约金为合同总价的百分之三，预付款比例为30%，进度款70%。"),
    (7, "合同总价为人民币壹佰贰拾万元整，工期120天。"),
    (8, "合同金额为350.5万元。逾期违约金每日万分之五。"),
    (9, ""),
    (10, "质量保证金5%，保修金不得高于10%。Payment terms: net 30 days."),
]
