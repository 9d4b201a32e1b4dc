"""Secret scan with corpus-wide ownership frequency, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, join_keyed, read

# Kinds in order. Group 1 comes before the secret, group 2 is the secret.
KINDS = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"()(AKIA[A-Z0-9]+)",
    "hex": r"()([0-9a-f]+)",
    "github": r"()(gh[oprsu]_[A-Za-z0-9]{36,})",
    "slack": r"()(xox[abprs]-[A-Za-z0-9-]{10,})",
    "jwt": r"()(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    "pem": r"()(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)",
}
#: Kinds whose matches count, of those that are always reported, and how long a secret has to be.
BASE = ("assign", "access", "hex")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: What a text must have for a kind to be looked for: cheap, and never stricter than the kind itself.
HINTS = {"assign": KINDS["assign"], "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "github": "gh[oprsu]_", "slack": "xox[abprs]-", "jwt": "eyJ", "pem": "-----BEGIN "}
#: Secrets of at least so many owners are examples that people copied.
MANY_OWNERS = 3
PLACEHOLDER = "example|changeme|placeholder|dummy|xxxx"


def _parts(text: Column, kind: str) -> Column:
    """(n, secret, looks_live) of the pieces of a text: gaps and matches in turn, a gap first.

    Control characters that mark the pieces are first replaced in the text by another one, which no kind
    matches either, so lengths stay as they are.
    """
    clean = F.translate(text, "\x00\x02", "\x01\x01")
    pieces = F.split(F.regexp_replace(clean, KINDS[kind], "\x00$1\x02$2\x00"), "\x00", -1)

    def part(p: Column, i: Column) -> Column:
        secret = F.substring_index(p, "\x02", -1)
        is_match = (i % 2 == 1) & (F.length(secret) >= LEAST.get(kind, 1))
        live = (F.size(F.array_distinct(F.split(secret, ""))) >= 8) & ~F.lower(secret).rlike(PLACEHOLDER)
        return F.struct((F.length(p) - i % 2).cast("long").alias("n"), F.when(is_match, F.sha2(secret, 256)).alias("hash"), F.coalesce(is_match & live, F.lit(False)).alias("live"))

    return F.transform(pieces, part)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, many_owners: int = MANY_OWNERS) -> DataFrame:
    """(row, doc_id, secrets) for every row of `docs`; secrets is an array of (start, kind, end, hash, owners, repos, verdict).

    Spans are code points, end exclusive, sorted by start and then kind (its index in KINDS). Matches are
    leftmost and don't overlap within a kind; those with too short a secret are dropped after matching.
    Only hashes of secrets leave the scan. Each hash is counted over the whole corpus by distinct
    repository and owner (both by default unknown, so one owner): with `many_owners` or more the verdict
    is "example"; otherwise "live" for a secret that looks random, else "weak".

    A null text is empty; a null repository or owner counts as one of its own name. Repeated rows are
    scanned alike, and don't add owners. Columns of other names are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<n:bigint,hash:string,live:boolean>>")
    looked = [F.struct(F.lit(i).alias("kind"), F.when(text.rlike(HINTS[k]), _parts(text, k)).otherwise(none).alias("parts")) for i, k in enumerate(KINDS)]
    found = F.when(text.rlike("|".join(f"(?:{h})" for h in HINTS.values())), F.filter(F.array(*looked), lambda x: F.size(x["parts"]) > 1))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    scanned = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), name(repo).alias("repo"), name(owner).alias("owner"), found.alias("found")))

    flat = scanned.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.kind", F.posexplode("f.parts").alias("ix", "p"))
    before = Window.partitionBy("row", "kind").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("p.n").over(before), F.lit(0))
    spans = cut(flat.select("row", "repo", "owner", "kind", start.alias("start"), (start + F.col("p.n")).alias("end"), "p.hash", "p.live").where("hash is not null"))
    owned = spans.select("hash", "repo", "owner").distinct().groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    verdict = F.when(F.col("owners") >= many_owners, "example").when(F.col("live"), "live").otherwise("weak")
    judged = join_keyed(spans, owned, "hash", "inner").select("row", F.struct("start", "kind", "end", "hash", "owners", "repos", verdict.alias("verdict")).alias("s"))
    lists = judged.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string,owners:bigint,repos:bigint,verdict:string>>")
    return scanned.select("row", "doc_id").join(lists, "row", "left").select("row", "doc_id", F.coalesce("secrets", empty).alias("secrets"))


def masked(text: Column, secrets: Column, verdicts: tuple[str, ...] = ("live",)) -> Column:
    """A text with the secrets of these verdicts replaced by asterisks, code point for code point."""
    hit = F.filter(secrets, lambda s: s["verdict"].isin(*verdicts))
    replace = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.repeat(F.lit("*"), (s["end"] - s["start"]).cast("int")), F.substring(t, (s["end"] + 1).cast("int"), F.length(t)))
    return F.aggregate(hit, F.coalesce(text, F.lit("")), replace)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    is_kind = lambda i: lambda s: s["kind"] == i
    n = lambda keep: F.size(F.filter("secrets", keep)).cast("long")
    return found.select(
        "doc_id",
        *(n(is_kind(i)).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"),
        n(lambda s: s["verdict"] == "example").alias("n_example"),
        n(lambda s: s["verdict"] == "live").alias("n_live"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT row, repo, owner, {i} AS kind, '{k}' AS name, {LEAST.get(k, 1)} AS least, string_split(regexp_replace(t, {quoted(KINDS[k])}, chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) AS pieces FROM d" for i, k in enumerate(KINDS)
    )
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t,
                          concat_ws('/', source, lang) AS repo, coalesce(source, '') AS owner FROM documents),
        k AS ({kinds}),
        p AS (SELECT row, repo, owner, kind, name, least, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS ix FROM k),
        parts AS (SELECT *, length(piece) - ix % 2 AS n, CASE WHEN ix % 2 = 1 THEN split_part(piece, chr(2), -1) END AS secret FROM p),
        spans AS (
            SELECT row, repo, owner, kind, name, "end" - n AS start, "end", secret FROM (
                SELECT *, sum(n) OVER (PARTITION BY row, kind ORDER BY ix) AS "end" FROM parts)
            WHERE length(secret) >= least),
        owned AS (SELECT secret, count(DISTINCT owner) AS owners FROM spans GROUP BY 1),
        judged AS (
            SELECT row, kind, start, name || ':' || start::BIGINT || ':' || "end"::BIGINT AS line, owners >= {MANY_OWNERS} AS example,
                   len(list_distinct(string_split(secret, ''))) >= 8 AND NOT regexp_matches(lower(secret), '{PLACEHOLDER}') AS live
            FROM spans JOIN owned USING (secret)),
        per AS (
            SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                   string_agg(line, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(line, ',' ORDER BY start, kind) AS spans,
                   count(*) FILTER (example) AS n_example, count(*) FILTER (live AND NOT example) AS n_live
            FROM judged GROUP BY row)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
        FROM d LEFT JOIN per USING (row)"""


QUERIES = {"op2_secrets": op2_secrets}
ORACLES = {"op2_secrets": _sql()}
