"""Splitting documents: contracts, clauses, chapters, sentences; and features of clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship

# Headings, and keywords of clause types in order of priority.
ARTICLE = r"第\s*[一二三四五六七八九十\d]+\s*[条章]"
SECTION = r"[一二三四五六七八九十]+、"
PAREN = r"[（(][一二三四五六七八九十]+[）)]"
ARABIC = r"\d+\s*[.、]"
CLAUSE_TYPES = [
    ("保修", ["保修", "质保", "缺陷责任", "防水", "管线"]),
    ("付款", ["付款", "支付", "结算", "进度款", "预付款", "工程款", "发票", "拨款"]),
    ("验收", ["验收", "竣工", "交付", "移交", "接收", "组织验收"]),
    ("违约", ["违约", "罚金", "罚款", "逾期", "赔偿", "责任"]),
    ("担保", ["担保", "保证金", "保函", "履约", "投标"]),
    ("质保金", ["质保金", "质量保证金", "保修金"]),
    ("安全", ["安全", "事故", "防护", "危险"]),
    ("争议", ["争议", "仲裁", "诉讼", "管辖"]),
    ("工期", ["工期", "开工", "竣工日期", "合同工期"]),
    ("工程概况", ["工程概况", "工程名称", "工程地点", "承包范围"]),
]
HEADER, FOOTER, WHOLE, OTHER = "头部", "尾部", "全文", "其他"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _lines(docs: DataFrame, id_col: str, text_col: str, sep: str) -> DataFrame:
    return docs.where(stripped(F.coalesce(F.col(text_col), F.lit(""))) != "").select(id_col, F.posexplode(F.split(text_col, sep)).alias("n", "line"))


def _joined(lines: DataFrame, id_col: str, *keys: str) -> DataFrame:
    """Lines of each block in order, without blank ones at the ends."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return lines.groupBy(id_col, *keys).agg(ordered.alias("lines"))


def split_contracts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment_ix, title, text): a document cut at lines that start with "# ".

    Text before the first heading is a segment of its own; a document without headings is one segment.
    A segment has its heading, its lines, and (as a heading's text runs to where the next one's begins)
    the next heading line. Blank documents have no segment.
    """
    w = Window.partitionBy(id_col).orderBy("n")
    heading = F.col("line").startswith("# ") & (F.length("line") > 2)
    marked = _lines(docs, id_col, text_col, "\n").withColumn("block", F.sum(heading.cast("int")).over(w)).withColumn("next", F.lead("block").over(w))
    # the next heading line belongs to this block as well
    rows = marked.select(id_col, "n", "line", "block").unionByName(marked.where("block > 0").select(id_col, "n", "line", F.col("block").alias("b")).where(heading & (F.col("b") > 1)).select(id_col, "n", "line", (F.col("b") - 1).alias("block")))
    blocks = _joined(rows, id_col, "block").join(marked.groupBy(id_col).agg(F.max("block").alias("blocks")), id_col)
    title = stripped(F.substring(F.get("lines", F.lit(0)), F.lit(3), F.length(F.get("lines", F.lit(0)))))
    body = stripped(F.array_join(F.when(F.col("block") > 0, F.concat(F.array(F.concat(F.lit("# "), title)), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))))).otherwise(F.col("lines")), "\n"))
    whole = docs.select(id_col, F.col(text_col).alias("whole"))
    out = blocks.select(id_col, "block", "blocks", title.alias("t"), body.alias("body")).where("body <> ''").join(whole, id_col)
    name = F.when(F.col("blocks") == 0, WHOLE).when(F.col("block") == 0, "前言/无标题").otherwise(F.col("t"))
    return out.select(id_col, F.col("block").cast("int").alias("segment_ix"), name.alias("title"), F.when(F.col("blocks") == 0, F.col("whole")).otherwise(F.col("body")).alias("text"))


def clause_id(line: Column) -> Column:
    s = stripped(line)
    tries = [F.regexp_extract(s, rf"(?U)^({ARTICLE})", 1), F.regexp_extract(s, rf"^({SECTION})", 1), F.regexp_extract(s, rf"^({PAREN})", 1), F.regexp_replace(F.regexp_extract(s, r"(?U)^(\d+[.、])", 1), "[.、]$", ".")]
    return F.coalesce(*(F.when(t != "", t) for t in tries), F.substring(s, 1, 20))


def clause_type(title: Column, content: Column) -> Column:
    head = F.concat(title, F.lit(" "), F.substring(content, 1, 200))
    out = F.lit(OTHER)
    for name, words in reversed(CLAUSE_TYPES):
        out = F.when(head.rlike("|".join(words)), name).otherwise(out)
    return out


def split_clauses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clause_ix, clause_id, clause_title, clause_type, type_confidence, content, level).

    A line that begins with an article, section or parenthesised numeral starts a clause; what stands
    before the first one is the header. A document without such lines is one clause.
    """
    lines = _lines(docs, id_col, text_col, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85  ]")
    s = stripped(F.col("line"))
    boundary = s.rlike(rf"(?U)^(?:{ARTICLE}|{SECTION}|{PAREN})")
    w = Window.partitionBy(id_col).orderBy("n")
    marked = lines.withColumn("block", F.sum(boundary.cast("int")).over(w)).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    blocks = _joined(marked, id_col, "block").join(marked.groupBy(id_col).agg(F.max("block").alias("blocks")), id_col)
    content = F.regexp_replace(F.array_join("lines", "\n"), r"(?U)^(?:[^\S\n]*\n)+|\s+$", "")
    first = stripped(F.get("lines", F.lit(0)))
    out = blocks.select(id_col, "block", "blocks", first.alias("first"), content.alias("content")).where(stripped(F.col("content")) != "")
    header, whole = (F.col("block") == 0) & (F.col("blocks") > 0), F.col("blocks") == 0
    title = F.when(header, "合同头部").when(whole, WHOLE).otherwise(F.col("first"))
    kind = F.when(header, HEADER).otherwise(clause_type(F.when(whole, "").otherwise(F.col("first")), F.col("content")))
    ix = F.row_number().over(Window.partitionBy(id_col).orderBy("block")) - 1
    level = F.when(header | whole, 0).when(F.col("first").rlike(rf"(?U)^{ARTICLE}"), 1).when(F.col("first").rlike(rf"^{SECTION}"), 2).when(F.col("first").rlike(rf"^{PAREN}"), 3).otherwise(1)
    return out.select(id_col, ix.alias("clause_ix"), F.when(header, HEADER).when(whole, WHOLE).otherwise(clause_id(F.col("first"))).alias("clause_id"), title.alias("clause_title"), kind.alias("clause_type"), F.when(header, 1.0).when(kind == OTHER, 0.0).otherwise(0.9).alias("type_confidence"), "content", level.alias("level"))


def scoped(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, clause_type, scope): the clauses of each type of a document, joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("clause_ix", "content"))), lambda x: x["content"])
    return clauses.groupBy(id_col, "clause_type").agg(F.array_join(parts, "\n").alias("scope"))


def with_scopes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "scopes") -> DataFrame:
    """The documents with a map of clause types to the joined clauses of each type."""
    parts = scoped(split_clauses(docs, id_col, text_col), id_col).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("clause_type", "scope"))).alias(name))
    return docs.join(parts, id_col, "left")


def sentences(text: Column) -> Column:
    """Sentences of a text without its line breaks, cut after 。；！？."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]", ""), "(?<=[。；！？])"), stripped), lambda s: s != "")


# Kinds of headings in order, how a line of each begins, and what of it is no title.
HEADINGS = [
    ("chinese_chapter", r"^第[一二三四五六七八九十百千\d]+[章节]", r"^第[一二三四五六七八九十百千\d]+[章节]\s*"),
    ("chinese_numbered", r"^[一二三四五六七八九十]+、", r"^[一二三四五六七八九十]+、\s*"),
    ("arabic_numbered", r"^\d+(?:\.\d+)*\.?\s+", r"^\d+(?:\.\d+)*\.?\s+"),
    ("roman_numbered", r"^[IVXLCDM]+\.\s+", r"^[IVXLCDM]+\.\s+"),
    ("chinese_section", r"^(总则|分则|附则|通则|补则|定义|术语)", None),
    ("all_caps", r"^[A-Z][A-Z\s/-]{3,60}$", None),
    ("markdown_atx", r"^#{1,6}\s+", r"^#{1,6}\s+"),
]
LONGEST_HEADING = 120
_HEADINGS = [(k, re.compile(p), re.compile(c) if c else None) for k, p, c in HEADINGS]


def heading(line: str) -> tuple[str, int] | None:
    """Title and level of a line that is a heading: # to ###### and the dots of a number give levels, all else is level 1."""
    s = line.strip()
    if not s or len(s) > LONGEST_HEADING:
        return None
    for kind, pattern, cleaner in _HEADINGS:
        m = pattern.match(s)
        if m:
            level = len(m[0].rstrip()) if kind == "markdown_atx" else min(3, 1 + m[0].count(".")) if kind == "arabic_numbered" else 1
            return (cleaner.sub("", s).strip() if cleaner else "") or s, level
    return None


def chapters_of(text: str, least_chars: int = 50, most: int | None = None) -> list[tuple[int, str, int, str]]:
    """(number, title, level, body) of a text's chapters.

    A body runs to the next heading of the same or a higher level, without its blank lines. A text with
    fewer than two headings is cut at blank lines instead, and the first line of several is the title.
    Bodies of fewer than `least_chars` characters are left out; of the others all are given, or the first `most`.
    """
    lines = text.splitlines()
    heads = [(i, *h) for i, line in enumerate(lines) if (h := heading(line))]
    parts: list[tuple[int, str, int, str]] = []
    if len(heads) > 1:
        until = [len(lines)] * len(heads)
        still: list[int] = []  # headings whose body goes on, their levels ascending
        for n, (line, _, level) in enumerate(heads):
            while still and heads[still[-1]][2] >= level:
                until[still.pop()] = line
            still.append(n)
        parts = [(n, title, level, "\n".join(x for x in lines[line + 1 : until[n]] if x.strip()).strip()) for n, (line, title, level) in enumerate(heads)]
    else:
        blocks = [b for b in (x.strip() for x in re.split(r"\n\s*\n", text)) if len(b) >= least_chars]
        for n, block in enumerate(blocks):
            first, *rest = block.splitlines()
            parts.append((n, first.strip().rstrip("。；;.,") if rest else "", 1, ("\n".join(rest) if rest else first).strip()))
    return [p for p in parts if len(p[3]) >= least_chars][:most]


def chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 50, most: int | None = None) -> DataFrame:
    """(id, chapter_ix, title, level, body): see chapters_of(). A text is cut in one pass, in Arrow batches; null texts have no chapters."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<chapter_ix:int,title:string,level:int,body:string>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("chapter_ix", "title", "level", "body")
        for batch in it:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in chapters_of(t, least_chars, most)] for t in batch], dtype=object)

    return docs.select(id_col, F.explode(run(F.coalesce(F.col(text_col), F.lit("")))).alias("c")).select(id_col, "c.*")


# Chapters and articles of a statute, and numbered headings.
_CHAPTER = re.compile(r"(第[一二三四五六七八九十百千]+章)\s*(.*)")
_STATUTE_ARTICLE = re.compile(r"(第[一二三四五六七八九十百千]+条)\s*")
_NUMBERED = re.compile(r"^(\d+[.、]\s*.+)$", re.MULTILINE)


def units_of(text: str) -> list[tuple[str, int, str, str]]:
    """(title, level, body, chapter) of a text's units: chapters, each followed by its articles; else numbered headings; else the whole.

    What stands before the first chapter or heading belongs to none. An article's chapter is named with it.
    """
    def between(marks: list[re.Match], whole: str) -> list[str]:
        until = [*(m.start() for m in marks[1:]), len(whole)]
        return [whole[m.end() : end].strip() for m, end in zip(marks, until, strict=False)]

    chapters_ = list(_CHAPTER.finditer(text))
    if chapters_:
        out = []
        for m, body in zip(chapters_, between(chapters_, text), strict=True):
            title = (m[1] + m[2]).strip()
            articles = list(_STATUTE_ARTICLE.finditer(body))
            out.append((title, 1, body, ""))
            out += [(a[1], 2, b, title) for a, b in zip(articles, between(articles, body), strict=True)]
        return out
    numbered = list(_NUMBERED.finditer(text))
    if numbered:
        return [(m[1].strip(), 1, b, "") for m, b in zip(numbered, between(numbered, text), strict=True)]
    return [(WHOLE, 0, text.strip(), "")]


def document_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit_ix, title, level, body, chapter): see units_of(), in Arrow batches. A null text is an empty one, with one empty unit."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<title:string,level:int,body:string,chapter:string>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield pd.Series([[dict(zip(("title", "level", "body", "chapter"), u, strict=True)) for u in units_of(t)] for t in batch], dtype=object)

    return docs.select(id_col, F.posexplode(run(F.coalesce(F.col(text_col), F.lit("")))).alias("unit_ix", "u")).select(id_col, "unit_ix", "u.*")


def annotate(text: Column, offset: Column, around: int = 50) -> Column:
    """Where an offset of a text is: line number, snippet with ellipses, nearest heading before."""
    before = F.substring(text, F.lit(1), offset)
    start, end = F.greatest(offset - around, F.lit(0)), F.least(offset + around, F.length(text))
    snippet = F.concat(F.when(start > 0, "...").otherwise(""), T.between(text, start, end), F.when(end < F.length(text), "...").otherwise(""))
    heads = F.filter(F.split(before, "\n"), lambda x: x.rlike(rf"(?U)^\s*(?:#|{ARTICLE}|{SECTION})"))
    return F.struct((F.size(F.split(before, "\n", -1))).alias("line"), snippet.alias("snippet"), F.when(F.size(heads) > 0, stripped(F.element_at(heads, -1))).alias("section"))


def features(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, clause_ix, features): 14 numbers of 0 to 1 for each clause.

    Position, characters and lines (relative to the document's largest clause), level, kind of heading,
    line length, digits, numbers, Chinese numerals, percentages, ideographs, punctuation, distinct
    characters, and how much line lengths vary.
    """
    c = F.col("content")
    n = F.length(c).cast("double")
    per = F.greatest(n, F.lit(1.0))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.length(stripped(x)).cast("double")), lambda k: k > 0)
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    doc, before = Window.partitionBy(id_col), Window.partitionBy(id_col).orderBy("clause_ix").rowsBetween(Window.unboundedPreceding, -1)
    base = clauses.select(id_col, "clause_ix", "clause_title", "level", c.alias("content"), n.alias("n"), F.size(F.split(c, "\n")).cast("double").alias("n_lines"), lines.alias("lines"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size("lines") > 0, total(F.col("lines")) / F.size("lines")).otherwise(0.0)
    spread = F.sqrt(F.aggregate("lines", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("lines"))
    title = F.col("clause_title")
    marker = F.when(title.rlike(rf"(?U){ARTICLE}"), 1.0).when(stripped(title).rlike(rf"^{SECTION}"), 0.66).when(stripped(title).rlike(rf"^{PAREN}"), 0.33).when(stripped(title).rlike(rf"(?U)^{ARABIC}"), 0.66).otherwise(0.0)
    rows = base.withColumn("mean", mean)
    cap = lambda x: F.least(x, F.lit(1.0))
    values = [
        F.coalesce(F.sum("n").over(before), F.lit(0.0)) / F.greatest(F.sum("n").over(doc), F.lit(1.0)),
        cap(n / F.greatest(F.max("n").over(doc), F.lit(1.0))),
        cap(F.col("n_lines") / F.max("n_lines").over(doc)),
        F.when(F.col("level") > 0, cap(F.col("level") / 3.0)).otherwise(0.0),
        marker,
        cap(F.col("mean") / 200.0),
        count("[0-9]") / per,
        cap(count(r"[0-9]+(?:\.[0-9]+)?") / 30.0),
        cap(count("[一二三四五六七八九十百千万]+") / 30.0),
        cap(count("[%％]") / 10.0),
        count(f"[{T.HAN}]") / per,
        count(r"[，。；：、！？,.;:!?()（）]") / per,
        F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))) / per,
        F.when((F.size("lines") >= 2) & (F.col("mean") > 0), F.least(spread / F.col("mean"), F.lit(2.0)) / 2.0).otherwise(0.0),
    ]
    return rows.select(id_col, "clause_ix", F.array(*(v.cast("double") for v in values)).alias("features"))
