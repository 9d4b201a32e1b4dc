"""Longer jobs made of the operators: reading a statute into a package, and admitting its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import term_set_domain
from .clauses import chapters
from .extraction import as_candidates, extract_rules, gates
from .rules import Rule, evaluate


def book_rules(books: DataFrame, sets: dict[str, dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rules of books, chapter by chapter: (id, chapter_ix, domain, rule...).

    A book without headings is one chapter. Of rules whose source begins with the same 60 characters in a
    domain, the first chapter's stays.
    """
    parts = chapters(books, id_col, text_col)
    rest = books.join(parts.select(id_col).distinct(), id_col, "left_anti").select(id_col, F.lit(0).alias("chapter_ix"), F.col(text_col).alias("body"))
    rows = parts.select(id_col, "chapter_ix", "body").unionByName(rest)
    rows = rows.select(F.struct(id_col, "chapter_ix").alias("part"), term_set_domain(F.col("body"), sets)["domain"].alias("domain"), F.col("body").alias("text"))
    found = extract_rules(rows, "part").join(rows.select("part", "domain"), "part")
    best = found.groupBy("domain", F.substring("source_text", 1, 60).alias("_k"), "condition_type").agg(F.min_by(F.struct(*found.columns), F.struct(F.col("part"), F.col("subject"))).alias("r"))
    return best.select(F.col(f"r.part.{id_col}").alias(id_col), "r.part.chapter_ix", "r.domain", "r.condition_type", "r.subject", "r.operator", "r.expected", "r.unit", "r.terms", "r.confidence", "r.source_text")


def as_rules(extracted: DataFrame, package: str, most: int = 10_000) -> list[Rule]:
    """Rules of a package from extracted rows; a package is compiled on the driver, so it has at most `most` rules."""
    rows = as_candidates(extracted).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{package} has more than {most} rules")
    out = []
    for i, r in enumerate(sorted(rows, key=lambda r: (r.condition_type, r.subject))):
        terms = list(r.terms or [r.subject])
        if r.condition_type in ("numeric_comparison", "sum_numeric_comparison"):
            params = {"label": r.subject, "context_pattern": r.context_pattern, "operator": r.operator, "expected": r.expected or 0, "unit": r.unit or "年", "legal_ref": r.legal_ref}
        elif r.condition_type == "co_occurrence":
            params = {"antecedent": terms[0], "consequent": terms[1] if len(terms) > 1 else ""}
        else:
            params = {"terms": terms} | ({"threshold": 2} if r.condition_type == "mutual_exclusion" else {})
        out.append(Rule(f"auto_{i:04d}", r.condition_type, params, name=r.subject, severity=r.severity, clause_type=r.clause_type, category="auto-extracted", package_id=package, source="auto-extracted", source_credibility=0.7, extraction_method="template_extract"))
    return out


def ingest(sources: DataFrame, samples: DataFrame, established: list[Rule], package: str = "candidate") -> tuple[list[Rule], DataFrame]:
    """Extract rules from sources, put them through the three gates over samples (sample_id, text, expected), and return those admitted with the gates' table.

    The gates do run here; a rule that fails one is left out.
    """
    rules = as_rules(extract_rules(sources), package)
    if not rules:
        empty = samples.sparkSession.createDataFrame([], "rule_id string, applicable boolean, negatives boolean, consistent boolean, accepted boolean")
        return [], empty
    evidence = evaluate(samples, [*rules, *established], id_col="sample_id")
    own = evidence.select("sample_id", "rule_id", (F.col("package_id") == package).alias("is_candidate"), "status", F.sha2("input_fragment", 256).alias("fragment"))
    table = gates(own, samples.select("sample_id", "expected"))
    accepted = {r.rule_id for r in table.where("accepted").collect()}  # rules of one package
    return [r for r in rules if r.id in accepted], table
