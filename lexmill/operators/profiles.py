"""Profiles of documents and sources: contract kinds, layered domains, feasibility, promotion, feedback, synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from ..functions.numerals import contract_value
from .mining import chi_squared

# Wording and limits of the contract profile, sources, hierarchies and directions.
SOURCES = [("国标|gb[/\\s]|iso[/\\s]|ieee[/\\s]", "行业标准"), ("最高人民法院|国务院|部令|法规|条例", "官方机构"), ("学术期刊|大学学报|doi:", "学术期刊"), ("llm提取|ai生成|auto[-_]extract|conjecture", "LLM提取"), ("manual|人工|hand[-_]written", "个人编写")]
EXCEPTIONS = "除非|例外|除.*外|不适用|免责|unless|except|not applicable"
QUALIFIERS = "部分|有限|经.*同意|在.*范围内|partially|limited to|subject to"
TRUSTED = ("法律", "行政法规", "部门规章", "国家标准", "司法解释")
DIRECTIONS = [
    (["supports", "confirms", "proves", "demonstrates", "shows", "finds"], ["refutes", "disproves", "contradicts", "fails to support", "no evidence", "does not support"]),
    (["increases", "raises", "improves", "enhances", "boosts", "positively affects"], ["decreases", "lowers", "reduces", "diminishes", "harms", "negatively affects"]),
    (["is", "equals", "represents"], ["is not", "differs from", "is distinct from"]),
    (["effective", "works", "successful", "beneficial"], ["ineffective", "does not work", "unsuccessful", "harmful", "no effect"]),
    (["significant", "statistically significant", "meaningful"], ["not significant", "non-significant", "no statistically significant"]),
]


def contract_types(text: Column) -> Column:
    """Tags of a contract by its value and wording; a subcontract that is forbidden is none."""
    value = contract_value(text)
    general = text.contains("总承包") | text.contains("总包")
    part = text.contains("分包") & ~text.rlike(r"(?:不得|禁止|不可|严禁|不应|不许)\S{0,20}分包")
    small = text.contains("屋面防水") | text.contains("外墙保温")

    def tags(v: Column) -> Column:
        some = F.filter(F.array(F.when(v > 50_000_000, F.lit("大型工程")), F.when(general, F.lit("施工总承包")).when(part, F.lit("专业分包")), F.when(small & (v < 100_000), F.lit("小型维修"))), lambda t: t.isNotNull())
        return F.when(F.size(some) > 0, some).otherwise(F.array(F.when(v > 10_000_000, F.lit("大型工程")).otherwise(F.lit("中小型工程"))))

    return T.let(value, tags)


def keyword_domain(text: Column, keywords: dict[str, list[str]], unknown: str = "未知") -> Column:
    """The domain with most keywords in a text's first 500 characters, the first of equals; unknown without any."""
    head = F.substring(text, 1, 500)
    hits = F.array(*(F.struct(sum((head.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, (d, ws) in enumerate(keywords.items())))
    return T.let(F.array_max(hits), lambda m: F.when(m["n"] > 0, m["d"]).otherwise(unknown))


def layered_domain(lexical: Column, candidate: Column, term_set: Column, confidence: Column, distance: Column, prototype: Column, override: Column, keyword: Column, unknown: str | None = "未知") -> Column:
    """(domain, source, confidence): the first layer that is sure.

    Lexical prototypes (0.9), candidate prototypes (0.6), a term set of 0.40 or more, a prototype nearer
    than 3 (unless wording overrides it), else keywords; of the last two, confidence falls with distance.
    A term set that says `unknown` gives no answer; with None, all that it says are answers.
    """
    out = lambda d, s, c: F.struct(d.alias("domain"), F.lit(s).alias("source"), c.cast("double").alias("confidence"))
    far = F.when(distance.isNotNull(), F.round(1 / (1 + distance), 3)).otherwise(0.0)
    near = F.coalesce(distance < 3, F.lit(False))
    told = term_set.isNotNull() if unknown is None else term_set != unknown
    return (
        F.when(lexical.isNotNull(), out(lexical, "lexical", F.lit(0.9)))
        .when(candidate.isNotNull(), out(candidate, "candidate", F.lit(0.6)))
        .when(F.coalesce(confidence >= 0.40, F.lit(False)) & told, out(term_set, "term_set", confidence))
        .when(near & override.isNotNull(), out(override, "keyword", far))
        .when(near, out(prototype, "prototype", far))
        .otherwise(out(keyword, "keyword", far))
    )


def rejected(text: Column, domain: Column, gate_words: list[str], unknown: str = "未知") -> Column:
    """Why a text is rejected (unknown domain, or fewer than two gate words), null if it is not."""
    hits = sum((text.contains(w).cast("int") for w in gate_words), F.lit(0))
    return F.when(domain == unknown, "unknown domain").when(hits < 2, "too few gate words")


def source_type(described: Column, maintainer: Column) -> Column:
    """The kind of a rule's source, by the first pattern that its description fits."""
    out = F.lit("未知")
    for pattern, kind in reversed(SOURCES):
        out = F.when(F.lower(described).rlike(pattern), kind).otherwise(out)
    return F.when(F.lower(maintainer).isin("auto-extracted", "auto_extracted", "llm", "conjecture"), "LLM提取").otherwise(out)


def feasible(status: Column, severity: Column, fragment: Column) -> Column:
    """(feasible, reasons): doubts about a failed rule: a soft severity, an exception or a qualifier in its fragment."""
    low = F.lower(fragment)
    reasons = F.filter(F.array(F.when(severity == "warning", F.lit("soft")), F.when(low.rlike(EXCEPTIONS), F.lit("exception")), F.when(low.rlike(QUALIFIERS), F.lit("qualified"))), lambda r: r.isNotNull())
    reasons = F.when(status == "FAILED", reasons).otherwise(F.array().cast("array<string>"))
    return F.struct((F.size(reasons) == 0).alias("feasible"), reasons.alias("reasons"))


def promotion(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, identity, quality, source, promoted): three gates of a candidate domain.

    A maintainer; a rule with credibility of 0.7 or more; a rule of a trusted hierarchy.
    """
    g = rules.groupBy("domain").agg(F.bool_or(F.col("source_credibility") >= 0.7).alias("q"), F.bool_or(F.coalesce(F.col("legal_hierarchy").isin(*TRUSTED), F.lit(False))).alias("s"))
    out = domains.join(g, "domain", "left").select("domain", (F.trim(F.coalesce("maintainer", F.lit(""))) != "").alias("identity"), F.coalesce("q", F.lit(False)).alias("quality"), F.coalesce("s", F.lit(False)).alias("source"))
    return out.withColumn("promoted", F.col("identity") & F.col("quality") & F.col("source"))


def checked_predicates(propositions: DataFrame, whitelist: list[str], known: list[str]) -> DataFrame:
    """Propositions (subject, predicate, confidence) with the reason why each is refused, null if it isn't."""
    c = F.col("confidence")
    why = F.when(F.col("subject").isNull() | F.col("predicate").isNull(), "missing field").when(~F.col("predicate").isin(*known), "unknown predicate").when(~F.col("predicate").isin(*whitelist), "not on whitelist").when(c.isNull() | (c < 0) | (c > 1), "confidence out of range")
    return propositions.withColumn("refused", why)


def direction(predicate: Column) -> Column:
    """1, -1 or 0: the first pair of opposite word sets with a word inside the predicate (so "is" fits many words)."""
    p = F.lower(F.trim(predicate))
    out = F.lit(0)
    for pos, neg in reversed(DIRECTIONS):
        fits = lambda ws: p.rlike("|".join(ws))
        out = F.when(fits(pos), 1).when(fits(neg), -1).otherwise(out)
    return out


def feedback(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """(text_hash, old_label, suggested, confidence, signal): corrections that evidence suggests.

    Of a failed row whose matched terms are mostly of another group than its clause type (two or more);
    and of a text whose clause types vary: three rows or more, and no type with 67 %. `evidence` has
    (ev_id, text_hash, clause_type, status, terms), `groups` has (group, term).
    """
    t = evidence.where("status = 'FAILED'").select("ev_id", "text_hash", "clause_type", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    g = t.join(F.broadcast(groups.select(F.lower("term").alias("_t"), "group")), F.lower(F.trim("term")) == F.col("_t"))  # an ontology's terms
    k = g.groupBy("ev_id", "text_hash", "clause_type", "n", "group").agg(F.count("*").alias("k"))
    top = k.groupBy("ev_id", "text_hash", "clause_type", "n").agg(F.max(F.struct("k", "group")).alias("m")).where("m.group <> clause_type and m.k >= 2")
    a = top.select("text_hash", F.col("clause_type").alias("old_label"), F.col("m.group").alias("suggested"), F.least(F.lit(0.85), 0.5 + F.col("m.k") / F.col("n") * 0.5).alias("confidence"), F.lit("terms").alias("signal"))
    c = evidence.where("text_hash <> '' and clause_type <> ''").groupBy("text_hash", "clause_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("text_hash").orderBy(F.desc("n"), "clause_type")
    r = c.withColumns({"rank": F.row_number().over(w), "second": F.lead("clause_type").over(w), "all": F.sum("n").over(Window.partitionBy("text_hash"))})
    b = r.where((F.col("rank") == 1) & F.col("second").isNotNull() & (F.col("n") / F.col("all") < 0.67) & (F.col("all") >= 3))
    return a.unionByName(b.select("text_hash", F.col("clause_type").alias("old_label"), F.col("second").alias("suggested"), F.lit(0.55).alias("confidence"), F.lit("inconsistent").alias("signal")))


# Tiers of synonyms by chi-squared, substitutable blocks and documents; the first that fits.
SYNONYM_TIERS = [("AUTO", 10.0, 3, 5), ("REVIEW", 6.63, 2, 0)]


def synonym_candidates(blocks: DataFrame, rules: dict[str, list[str]], grams, least: int = 3, around: int = 50, least_chi2: float = 3.84) -> DataFrame:
    """(rule_id, gram, chi2, substitutable, tier): grams that keep company with a rule's terms far more than with other texts.

    `blocks` has (block_id, doc_id, cluster, text), `rules` the terms of each rule, and grams() gives the
    grams of a text column. A rule's windows reach from `around` characters before the first of its terms
    to as many after the last, once in every block that has one. Blocks of clusters without any such
    block are the baseline, and blocks of the others that have the gram but none of the terms are
    substitutable. A gram needs `least` blocks and documents, and a rule as many blocks and baseline blocks.
    Blocks of a null cluster are in the baseline. Grams are counted by cluster before anything is joined.
    """
    names = list(rules)
    low = F.lower(F.coalesce("text", F.lit("")))
    spots = [[F.locate(t.lower(), low) for t in rules[r]] for r in names]
    flags = F.array(*(F.greatest(*s, F.lit(0)) > 0 for s in spots))
    ends = lambda r, s: F.greatest(*(F.when(p > 0, p + len(t)) for t, p in zip(rules[r], s, strict=True)), F.lit(0))
    starts = lambda s: F.least(*(F.when(p > 0, p) for p in s), F.lit(1 << 30))
    window = lambda r, s: let(F.greatest(starts(s) - around, F.lit(1)), lambda a: F.substring(low, a, ends(r, s) + around - a))
    windows = F.array(*(F.when(F.greatest(*s, F.lit(0)) > 0, F.struct(F.lit(i).alias("rule"), window(r, s).alias("window"))) for i, (r, s) in enumerate(zip(names, spots, strict=True))))
    base = blocks.select("block_id", "doc_id", "cluster", low.alias("low"), flags.alias("flags"), F.filter(windows, lambda w: w.isNotNull()).alias("windows"))

    each = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("rule")
    clusters = base.groupBy("cluster").agg(F.count("*").alias("blocks"), F.array(*(F.bool_or(F.col("flags")[i]) for i in range(len(names)))).alias("target"), F.array(*(F.count_if(F.col("flags")[i]) for i in range(len(names)))).alias("with_term"))
    aimed = lambda c: F.coalesce(F.get(c, F.col("rule")), F.lit(False)) & F.col("cluster").isNotNull()
    totals = clusters.select("*", each).groupBy("rule").agg(F.sum(F.when(aimed("target"), 0).otherwise(F.col("blocks"))).alias("m"), F.sum(F.get("with_term", F.col("rule"))).alias("n1")).where((F.col("m") >= least) & (F.col("n1") >= least))

    near = base.select("block_id", "doc_id", F.explode("windows").alias("w")).select("block_id", "doc_id", "w.rule", F.explode(F.array_distinct(grams(F.col("w.window")))).alias("gram"))
    seen = near.groupBy("rule", "gram").agg(F.count("*").alias("o11"), F.count_distinct("doc_id").alias("docs")).where((F.col("o11") >= least) & (F.col("docs") >= least))
    cells = base.select("cluster", "flags", F.explode(F.array_distinct(grams(F.col("low")))).alias("gram")).groupBy("gram", "cluster", "flags").agg(F.count("*").alias("n"))
    cells = cells.join(clusters.select(F.col("cluster").alias("_c"), "target"), F.col("cluster").eqNullSafe(F.col("_c"))).select("*", each)
    other = cells.groupBy("rule", "gram").agg(F.sum(F.when(aimed("target"), 0).otherwise(F.col("n"))).alias("o21"), F.sum(F.when(aimed("target") & ~F.get("flags", F.col("rule")), F.col("n")).otherwise(0)).alias("substitutable"))
    rows = seen.join(F.broadcast(totals), "rule").join(other, ["rule", "gram"])  # one row for each rule
    chi, _ = chi_squared(F.col("o11"), F.col("n1") - F.col("o11"), F.col("o21"), F.col("m") - F.col("o21"))
    out = rows.withColumn("chi2", chi).where((F.col("o11") / F.col("n1") > F.col("o21") / F.col("m")) & (F.col("chi2") >= least_chi2))
    tier = F.lit("SUGGEST")
    for name, at_chi2, blocks_, documents in reversed(SYNONYM_TIERS):
        tier = F.when((F.col("chi2") >= at_chi2) & (F.col("substitutable") >= blocks_) & (F.col("docs") >= documents), name).otherwise(tier)
    return out.select(F.get(F.array(*map(F.lit, names)), F.col("rule")).alias("rule_id"), "gram", "chi2", "substitutable", tier.alias("tier"))


def centroids(vectors: DataFrame, class_col: str, vector_col: str) -> DataFrame:
    """(class, centroid): the mean vector of each class."""
    long = vectors.select(F.col(class_col).alias("class"), F.posexplode(vector_col).alias("i", "x"))
    mean = long.groupBy("class", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_class(vectors: DataFrame, means: DataFrame, id_col: str, vector_col: str, least: float = 0.15) -> DataFrame:
    """(id, class, score): the class whose centroid is most similar by cosine, unknown under `least`. `means` has one row a class."""
    from .classify import cosine

    table = means.agg(F.collect_list(F.struct("class", "centroid")).alias("means")).withColumn("k", F.lit(0))  # classes are few
    scored = vectors.withColumn("k", F.lit(0)).join(F.broadcast(table), "k").select(id_col, F.array_max(F.transform("means", lambda m: F.struct(cosine(F.col(vector_col), m["centroid"]).alias("s"), m["class"].cast("string").alias("c")))).alias("best"))
    return scored.select(id_col, F.when(F.col("best.s") < least, "unknown").otherwise(F.col("best.c")).alias("class"), F.col("best.s").alias("score"))


def forall_violators(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows for which a condition that has to hold for all does not hold (unknown counts as not)."""
    return rows.where(~F.coalesce(condition, F.lit(False)))
