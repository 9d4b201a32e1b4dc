"""Jobs that read rules and values out of texts and put them to use: validation with extracted values, and a rule store that feeds itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .evidence import inject, injected
from .extraction import concepts, extract_rules, gates, over_sentences, rules_of
from .graph import reliable
from .jobs import as_rules
from .rules import Rule, evaluate
from .store import Versions

# What a retry of a rejected rule may add, and how far it is believed.
RETRY_CONCEPTS, RETRY_TERMS, RETRY_CREDIBILITY = 3, 6, 0.4


def _rule_of(subject: Column, unit: Column, rules: Iterable[Rule]) -> Column:
    """The id of the numeric rule whose label a subject is or holds, the longest of several; its unit has to be the same."""
    out, length = F.lit(None).cast("string"), F.lit(0)
    for r in sorted((r for r in rules if r.params.get("label")), key=lambda r: r.id):
        label = r.params["label"]
        fits = (subject == label) | subject.contains(label)
        fits = fits & (F.coalesce(unit, F.lit("")).isin("", r.params.get("unit") or "") | F.lit(not r.params.get("unit"))) & (length < len(label))
        out, length = F.when(fits, r.id).otherwise(out), F.when(fits, len(label)).otherwise(length)
    return out


def extracted_values(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule_id, value, unit, operator_hint, confidence, source_text): values that sentences state for numeric rules; the surest of a rule counts, of equals the smallest."""
    found = extract_rules(docs, id_col, text_col, values_only=True).where("expected is not null").withColumn("rule_id", _rule_of(F.col("subject"), F.col("unit"), rules)).where("rule_id is not null")
    best = F.min(F.struct((-F.col("confidence")).alias("k"), "expected", "unit", "operator", "source_text")).alias("b")
    return found.groupBy(id_col, "rule_id").agg(best).select(id_col, "rule_id", F.col("b.expected").alias("value"), "b.unit", F.col("b.operator").alias("operator_hint"), (-F.col("b.k")).alias("confidence"), "b.source_text")


_VALUES = {"rule_id": "string", "value": "double", "unit": "string", "operator_hint": "string", "confidence": "double", "source_text": "string"}


def values_in(text: str, found_in: Callable[[str], list[tuple]], labels: list[tuple[str, str, str]]) -> list[dict]:
    """extracted_values() of one text with a line for each sentence; `labels` has (id, label, unit) of rules in the order of their ids."""
    best: dict[str, tuple] = {}
    for r in rules_of(text, found_in):
        fits = [(-len(label), i, rule) for i, (rule, label, unit) in enumerate(labels) if label in r["subject"] and (not unit or (r["unit"] or "") in ("", unit))]
        if r["expected"] is None or not fits:
            continue
        rule, key = min(fits)[2], (-r["confidence"], r["expected"], r["unit"] is not None, r["unit"] or "", r["operator"], r["source_text"])
        best[rule] = min(best.get(rule, key), key)
    return [dict(zip(_VALUES, (rule, b[1], b[3] if b[2] else None, b[4], -b[0], b[5]), strict=True)) for rule, b in best.items()]


def _limits(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    limits = [(r.id, r.params.get("operator"), float(r.params.get("expected") or 0)) for r in rules if r.condition_type == "numeric_comparison"]
    return docs.sparkSession.createDataFrame(limits, "rule_id string, operator string, expected double")


def validate_with_extraction(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(evidence, fields): values are extracted, handed to the rules beside the text, and the texts validated.

    Rules without an extracted value read the text as ever. `fields` has what was extracted.
    """
    fields = reliable(extracted_values(docs, rules, id_col, text_col))
    given = fields.select(id_col, "rule_id", "value", "operator_hint", "confidence")
    return inject(evaluate(docs, rules, id_col, text_col), given, _limits(docs, rules), id_col), fields


def validate_rows_with_extraction(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """validate_with_extraction() of documents with one row each: evidence with the extracted fields beside it.

    All of a document is in its row, so it is read once, and nothing is shuffled, joined or kept between.
    """
    labels = [(r.id, r.params["label"], r.params.get("unit") or "") for r in sorted(rules, key=lambda r: r.id) if r.params.get("label")]
    fields = f"array<struct<{','.join(f'{k}:{v}' for k, v in _VALUES.items())}>>"
    kind = pa.list_(pa.struct([(k, pa.float64() if v == "double" else pa.string()) for k, v in _VALUES.items()]))
    ship(docs.sparkSession)
    read = docs.withColumn("_fields", over_sentences(F.col(text_col), lambda text, found_in: values_in(text, found_in, labels), fields, kind, values_only=True))
    evidence = evaluate(read, rules, id_col, text_col, keep=("_fields",))
    own = F.get(F.filter("_fields", lambda f: f["rule_id"] == F.col("rule_id")), F.lit(0))
    rows = evidence.withColumn("_own", own).drop("_fields").select("*", *(F.col("_own")[k].alias(k) for k in _VALUES if k != "rule_id")).drop("_own")
    return injected(rows, _limits(docs, rules))


def rule_key() -> Column:
    """A rule by what it says, wherever it comes from."""
    return F.sha2(F.concat_ws("|", "condition_type", "subject", F.coalesce("operator", F.lit("")), F.coalesce(F.col("expected").cast("string"), F.lit("")), F.coalesce("unit", F.lit("")), F.array_join(F.coalesce("terms", F.array().cast("array<string>")), ",")), 256)


_RULES = "key string, condition_type string, subject string, operator string, expected double, unit string, terms array<string>, confidence double, source_type string, source_text string, retry boolean, failed array<string>, accepted boolean"


class RuleStore(Versions):
    """Rules that were read out of sources, with the gates that they failed; a source or rule that is known is not looked at again."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, {"sources": "sha string", "rules": _RULES})

    def _judged(self, candidates: DataFrame, samples: DataFrame, established: list[Rule]) -> DataFrame:
        """Candidates with the gates that they fail."""
        keyed = candidates.select("key", F.lit("x").alias("domain"), *candidates.drop("key", "domain").columns)
        rules = as_rules(keyed, "candidate")
        by_id = [(r.id, k) for r, k in zip(rules, [x.key for x in sorted(keyed.select("key", "condition_type", "subject").collect(), key=lambda r: (r.condition_type, r.subject))], strict=True)]
        evidence = evaluate(samples, [*rules, *established], id_col="sample_id")
        own = evidence.select("sample_id", "rule_id", (F.col("package_id") == "candidate").alias("is_candidate"), "status", F.sha2("input_fragment", 256).alias("fragment"))
        table = gates(own, samples.select("sample_id", "expected")).join(F.broadcast(self.spark.createDataFrame(by_id, "rule_id string, key string")), "rule_id")
        failed = F.filter(F.array(F.when(~F.col("applicable"), "bench"), F.when(~F.col("negatives"), "bad_samples"), F.when(~F.col("consistent"), "constitution")), lambda g: g.isNotNull())
        return candidates.join(table.select("key", failed.alias("failed")), "key", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>"))).withColumn("accepted", F.size("failed") == 0)

    def _widened(self, words: list[str]) -> DataFrame:
        """Rejected rules that may be tried once more: those that failed on samples, with up to RETRY_CONCEPTS frequent concepts of the sources as further terms."""
        rejected = self.read()["rules"].where("not accepted and not retry and size(terms) > 0").where(F.arrays_overlap("failed", F.array(F.lit("bench"), F.lit("bad_samples"))))
        more = F.array(*map(F.lit, words)).cast("array<string>")
        wider = F.when(F.size("terms") < RETRY_TERMS, F.array_union("terms", more)).otherwise(F.col("terms"))
        rows = rejected.withColumns({"terms": wider, "retry": F.lit(True), "confidence": F.lit(RETRY_CREDIBILITY)}).drop("failed", "accepted", "key")
        return rows.withColumn("key", rule_key())

    def feed(self, sources: DataFrame, samples: DataFrame, established: list[Rule], text_col: str = "text") -> list[int]:
        """Reads new sources, tries their rules, then widens and retries rejected ones, until nothing new is admitted; how many each round admitted.

        `samples` has (sample_id, text, expected). Rules are known by what they say and sources by their text: feeding the same again
        admits nothing and writes nothing. A round is one version of the store, so a job that dies goes on from the last
        whole round. There are at most two rounds for each set of sources, as a rule is retried once.
        """
        texts = sources.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256)).dropDuplicates(["sha"])
        fresh = reliable(texts.join(self.read()["sources"], "sha", "left_anti"))
        admitted = []
        words = [r.term for r in concepts(texts, n=RETRY_CONCEPTS).orderBy(F.desc("freq"), "term").collect()]  # a top list
        found = extract_rules(fresh, "sha").withColumns({"key": rule_key(), "retry": F.lit(False)}).dropDuplicates(["key"])
        while True:
            seen = self.read()["sources"]
            unread = fresh.select("sha").join(seen, "sha", "left_anti")
            rows = (found.drop("sha") if not unread.isEmpty() else found.drop("sha").where("false")).unionByName(self._widened(words), allowMissingColumns=True)
            new = reliable(rows.dropDuplicates(["key"]).join(self.read()["rules"].select("key"), "key", "left_anti"))
            if new.isEmpty() and unread.isEmpty():
                return admitted
            columns = [c.split()[0] for c in _RULES.split(", ")]
            judged = reliable((self._judged(new, samples, established) if not new.isEmpty() else new.withColumns({"failed": F.array().cast("array<string>"), "accepted": F.lit(False)})).select(*columns))
            self.apply(f"round-{self.version()}", lambda t: {"sources": t["sources"].unionByName(unread), "rules": t["rules"].unionByName(judged)})
            admitted.append(judged.where("accepted").count())

    def package(self) -> list[Rule]:
        return as_rules(self.read()["rules"].where("accepted"), "store")
