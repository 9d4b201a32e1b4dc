"""Terms and concepts: variants, canonical names, taxonomies, and matching to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def expand_terms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(rule_id, terms): each term replaced by all terms of its groups, in order, the first of those equal up to case kept.

    `terms` has (rule_id, pos, term), `groups` has (group, gpos, term). A term of no group stays alone.
    """
    low = lambda c: F.lower(F.trim(c))
    member = groups.select(low(F.col("term")).alias("key"), "group").distinct()
    variants = groups.select("group", "gpos", F.col("term").alias("variant"))
    found = terms.withColumn("key", low(F.col("term"))).join(F.broadcast(member), "key", "left").join(F.broadcast(variants), "group", "left")  # an ontology's terms
    rows = found.select("rule_id", "pos", F.coalesce("gpos", F.lit(-1)).alias("gpos"), F.coalesce("variant", "term").alias("term"))
    own = terms.select("rule_id", "pos", F.lit(-1).cast("long").alias("gpos"), "term")
    firsts = rows.unionByName(own).groupBy("rule_id", low(F.col("term")).alias("key")).agg(F.min(F.struct("pos", "gpos", "term")).alias("m"))
    return firsts.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["term"]).alias("terms"))


def alternatives(pattern: str, groups: dict[str, list[str]]) -> str:
    """A plain pattern (?i)(a|b) with the variants of its terms added, escaped; other patterns as they are."""
    import re

    m = re.fullmatch(r"\(\?i\)\(([^()]*)\)", pattern)
    if not m:
        return pattern
    out: list[str] = []
    for term in m[1].split("|"):
        plain = term.strip()
        for v in [plain, *(x for g in groups.values() if plain.lower() in {t.lower() for t in g} for x in g)]:
            if v and v.lower() not in {o.lower() for o in out}:
                out.append(v)
    return "(?i)(" + "|".join(re.escape(o) for o in out) + ")"


def canonical_field(fields: DataFrame, surfaces: DataFrame, field_col: str = "field") -> DataFrame:
    """Each field with its `canonical` name: of the equal surface, else of the longest surface that it contains, else itself.

    Ties between surfaces of one length go to the one that sorts first.
    """
    s = F.broadcast(surfaces.select("surface", F.col("canonical").alias("_canonical")))  # a global ontology's surfaces
    hits = fields.select(field_col).distinct().join(s, F.expr(f"contains({field_col}, surface) and surface <> ''"))
    best = hits.groupBy(field_col).agg(F.max_by("_canonical", F.struct((F.col(field_col) == F.col("surface")).alias("equal"), F.length("surface").alias("n"), F.col("surface").alias("s"))).alias("_c"))
    return fields.join(best, field_col, "left").withColumn("canonical", F.coalesce("_c", field_col)).drop("_c")


def taxonomy_paths(edges: DataFrame, depth: int = 20) -> DataFrame:
    """(child, ancestor, distance) of a parent table (child, parent), up to `depth` steps, so cycles end as well."""
    out = level = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    known = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    for d in range(2, depth + 1):
        level = level.join(F.broadcast(known), "ancestor").select("child", F.col("next").alias("ancestor"), F.lit(d).alias("distance"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))


def taxonomy_depths(edges: DataFrame, depth: int = 20) -> DataFrame:
    """(concept, depth, descendants): steps to the farthest ancestor, and how many concepts are below, of all concepts in the table."""
    paths = taxonomy_paths(edges, depth).where("child <> ancestor")
    names = edges.select(F.col("child").alias("concept")).unionByName(edges.select(F.col("parent").alias("concept"))).distinct()
    up = paths.groupBy(F.col("child").alias("concept")).agg(F.max("distance").alias("depth"))
    down = paths.groupBy(F.col("ancestor").alias("concept")).agg(F.count("*").alias("descendants"))
    out = names.join(up, "concept", "left").join(down, "concept", "left")
    return out.select("concept", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("descendants", F.lit(0)).cast("long").alias("descendants"))


def taxonomy_faults(edges: DataFrame, concepts: DataFrame, depth: int = 20) -> DataFrame:
    """(concept, fault): members of a cycle, and parents that are no concept."""
    cycle = taxonomy_paths(edges, depth).where("child = ancestor").select(F.col("child").alias("concept"), F.lit("cycle").alias("fault"))
    orphan = edges.join(concepts.select(F.col("concept").alias("parent")), "parent", "left_anti").select(F.col("child").alias("concept"), F.lit("orphan").alias("fault"))
    return cycle.unionByName(orphan).distinct()


def match_any(text: Column, terms: list[str]) -> Column:
    """The terms that occur in a text, in order."""
    return F.filter(F.array(*(F.when(text.contains(t), F.lit(t)) for t in terms)), lambda t: t.isNotNull())


def nearest_number(candidates: DataFrame, by: str, least: bool, within: int = 80) -> DataFrame:
    """(by, value): of numbers (by, value, position) with context matches (start, end), the nearest one within 80 characters; ties to the smallest or largest value."""
    gap = F.when(F.col("position") >= F.col("end"), F.col("position") - F.col("end")).when(F.col("position") < F.col("start"), F.col("start") - F.col("position")).otherwise(0)
    near = candidates.withColumn("gap", gap).where(F.col("gap") <= within)
    w = Window.partitionBy(by).orderBy("gap", F.asc("value") if least else F.desc("value"))
    return near.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(by, "value")


def allowed_term(term: Column, whitelist: list[str]) -> Column:
    """How a term is on a whitelist: exact, contained one way or the other, sharing its last two characters, overlapping by half its characters; else null."""
    chars = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    any_of = lambda test: F.exists(F.array(*(F.lit(w) for w in whitelist)), test) if whitelist else F.lit(False)
    overlap = lambda w: F.size(F.array_intersect(chars(term), chars(w))) / F.greatest(F.size(chars(term)), F.lit(1)) >= 0.5
    return F.when(any_of(lambda w: w == term), "exact").when(any_of(lambda w: F.contains(w, term) | F.contains(term, w)), "substring").when(any_of(lambda w: F.endswith(w, F.substring(term, F.lit(-2), F.lit(2)))), "ending").when(any_of(overlap), "overlap")


def verified_extraction(rows: DataFrame) -> DataFrame:
    """Extracted rules (source_text, terms, value, unit, confidence) checked against their source.

    Terms that the source lacks are dropped; a value has to stand in it near its unit or by itself. A
    failure of either halves the confidence.
    """
    kept = F.filter("terms", lambda t: F.contains(F.col("source_text"), t))
    number = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    seen = F.col("value").isNull() | F.col("source_text").contains(number)
    bad = (F.size(kept) < F.size("terms")) | ~seen
    return rows.withColumns({"terms": kept, "confidence": F.when(bad, F.col("confidence") * 0.5).otherwise(F.col("confidence")), "value_found": seen})


def long_term_parts(terms: Column, stopwords: list[str]) -> Column:
    """Terms, those of more than four ideographs cut into windows of 2 and 3, without stopwords, in order and once each."""
    parts = F.flatten(F.transform(terms, lambda t: F.when(F.length(t) > 4, T.windows(t, 2, 3)).otherwise(F.array(t))))
    return F.array_distinct(F.filter(parts, lambda p: ~p.isin(*stopwords)) if stopwords else parts)
