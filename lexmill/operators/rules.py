"""Rules and their conditions, compiled to Column expressions.

A rule is compiled once, on the driver, into one expression over the text columns of a document; all
rules of a package go into one projection. So a table of documents is read once for any number of
rules, without a join, a shuffle or materialised n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import each_once
from ..functions.numerals import numbers
from ..shipping import ship

PASSED, FAILED, NOT_APPLICABLE = "PASSED", "FAILED", "NOT_APPLICABLE"
VERDICT = "struct<status:string,fragment:string,matched_terms:array<string>,rationale:string>"


@dataclass
class Rule:
    """One rule of a package; `params` depend on the condition type."""

    id: str
    condition_type: str
    params: dict = field(default_factory=dict)
    name: str = ""
    severity: str = "warning"
    category: str = ""
    package_id: str = "default"
    package_version: str = "1"
    version: str = "1"
    source: str = ""
    source_credibility: float = 0.5
    extraction_method: str = "manual"
    clause_type: str | None = None
    legal_hierarchy: str = ""
    exclude_contract_types: tuple[str, ...] = ()
    min_contract_value: float = 0.0


@dataclass
class Text:
    """The columns that conditions read: the text in scope, as it is and in lower case, and the full text."""

    text: Column
    low: Column
    full: Column
    full_low: Column
    markers: Column

    def has(self, term: str) -> Column:
        return T.has_term(self.low, term)


Handler = Callable[[dict, Text], Column]
HANDLERS: dict[str, Handler] = {}


def condition(name: str) -> Callable[[Handler], Handler]:
    """Register the builder of a condition type: (params, text) to a verdict expression."""

    def add(f: Handler) -> Handler:
        HANDLERS[name] = f
        return f

    return add


def strings(values: list) -> Column:
    return F.array(*values).cast("array<string>") if values else F.array().cast("array<string>")


def verdict(status: Column | str, fragment: Column, matched: Column, rationale: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    status = lit(status)
    return F.struct(status.alias("status"), F.substring(fragment, 1, 500).alias("fragment"), matched.alias("matched_terms"), F.concat(status, F.lit(": "), lit(rationale)).alias("rationale"))


def those(terms: list[str], holds: Callable[[str], Column]) -> Column:
    """The terms that hold, in order."""
    return F.filter(strings([F.when(holds(t), F.lit(t)) for t in terms]), lambda t: t.isNotNull()) if terms else strings([])


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def _head(x: Text) -> Column:
    return F.substring(x.text, 1, 200)


def listed(params: dict) -> list[str]:
    """The terms of a rule, or the alternatives of its plain pattern."""
    if params.get("terms"):
        return list(params["terms"])
    pattern = params.get("pattern") or ""
    inner = pattern.removeprefix("(?i)").strip("()")
    return [t.strip() for t in inner.split("|") if t.strip()]


@condition("mutual_exclusion")
def mutual_exclusion(params: dict, x: Text) -> Column:
    terms = list(params.get("terms", []))
    found = those(terms, x.has)
    bad = F.size(found) >= params.get("threshold", 2)
    return F.when(bad, verdict(FAILED, T.fragment(x.text, x.low, terms), found, F.concat(F.lit("mutually exclusive: "), F.array_join(found, ", ")))).otherwise(verdict(PASSED, _head(x), found, "no mutually exclusive terms"))


@condition("co_occurrence")
def co_occurrence(params: dict, x: Text) -> Column:
    a, c = params.get("antecedent", ""), params.get("consequent", "")
    bad = x.has(a) & ~x.has(c)
    return F.when(bad, verdict(FAILED, T.fragment(x.text, x.low, [a]), strings([F.lit(a)]), f"{a} without {c}")).otherwise(verdict(PASSED, _head(x), those([a, c], x.has), f"{a} absent or with {c}"))


@condition("forbidden_pattern")
def forbidden_pattern(params: dict, x: Text) -> Column:
    terms = listed(params)
    as_tokens = those(terms, x.has)
    plain = those(terms, lambda t: x.full.contains(t) | x.text.contains(t))
    matched = T.let(as_tokens, lambda m: F.when(F.size(m) > 0, m).otherwise(plain))
    ok = those(terms, lambda t: T.mostly_negated(x.full_low, t, markers=x.markers))
    parts = T.let(matched, lambda m: F.struct(m.alias("matched"), F.when(F.size(m) > 0, F.array_except(m, ok)).otherwise(m).alias("left")))
    bad = lambda p: verdict(FAILED, T.fragment(x.text, x.low, terms), p["left"], F.concat(F.lit("forbidden: "), F.array_join(p["left"], ", ")))
    fine = lambda p: verdict(PASSED, _head(x), p["matched"], "forbidden terms only where the text itself forbids them")
    none = verdict(PASSED, _head(x), strings([]), "no forbidden terms")
    if not terms and params.get("pattern"):
        hit = F.regexp_extract(x.text, params["pattern"], 0)
        return F.when(x.text.rlike(params["pattern"]), verdict(FAILED, hit, F.array(hit), "forbidden pattern")).otherwise(none)
    return T.let(parts, lambda p: F.when(F.size(p["left"]) > 0, bad(p)).when(F.size(p["matched"]) > 0, fine(p)).otherwise(none))


@condition("required_pattern")
def required_pattern(params: dict, x: Text) -> Column:
    original = listed(params)
    terms = list(dict.fromkeys([*original, *params.get("expanded", [])]))
    matched = those(terms, x.has)
    own = those(original, x.has)
    refused = those(original, lambda t: x.has(t) & T.always_refused(x.full_low, t, markers=x.markers))
    negated = (F.size(own) > 0) & (F.size(refused) == F.size(own))
    missing = verdict(FAILED, _head(x), strings([]), f"not found: {', '.join(terms) or params.get('pattern', 'unknown')}")
    return F.when((F.size(matched) > 0) & negated, verdict(FAILED, _head(x), matched, "found, but always refused")).when(F.size(matched) > 0, verdict(PASSED, _head(x), matched, F.concat(F.lit("found: "), F.array_join(matched, ", ")))).otherwise(missing)


@condition("logical_chain")
def logical_chain(params: dict, x: Text) -> Column:
    premises, conclusion = list(params.get("premises", [])), params.get("conclusion", "")
    bad = _all([x.has(p) for p in premises]) & ~x.has(conclusion)
    return F.when(bad, verdict(FAILED, T.fragment(x.text, x.low, premises), those(premises, x.has), f"premises without {conclusion}")).otherwise(verdict(PASSED, _head(x), those([*premises, conclusion], x.has), "chain holds"))


@condition("scope_constraint")
def scope_constraint(params: dict, x: Text) -> Column:
    """The delegate rule's verdict where a token of the scope occurs (single characters count), else not applicable."""
    scope = [w for w in T_tokens(params.get("scope", ""))]
    delegate = params.get("delegate") or {}
    kind = delegate.get("condition_type")
    inside = _any([x.has(w) for w in scope])
    out_of = verdict(NOT_APPLICABLE, _head(x), strings([]), "scope not present")
    if kind not in HANDLERS or params.get("delegate_disabled"):
        return F.when(inside, verdict(NOT_APPLICABLE, F.lit(""), strings([]), "no valid delegate")).otherwise(out_of)
    return F.when(inside, HANDLERS[kind](delegate.get("params", {}), x)).otherwise(out_of)


def T_tokens(scope: str) -> list[str]:
    """Tokens of a short driver-side string: Latin words, each ideograph, and windows of 2 to 6 ideographs."""
    out: list[str] = []
    word = run = ""
    for ch in scope.lower() + " ":
        cjk, latin = T.is_cjk(ch), ch.isascii() and (ch.isalnum() or ch == "_")
        if run and not cjk:
            out += [run[i : i + k] for k in range(1, min(6, len(run)) + 1) for i in range(len(run) - k + 1)]
            run = ""
        if word and not latin:
            out.append(word)
            word = ""
        run, word = run + ch * cjk, word + ch * latin
    return list(dict.fromkeys(out))


@condition("contextual_co_occurrence")
def contextual_co_occurrence(params: dict, x: Text) -> Column:
    a, b = (params.get("term_a") or "").lower(), (params.get("term_b") or "").lower()
    if not a or not b:
        return verdict(NOT_APPLICABLE, _head(x), strings([]), "a term is missing")
    w, least = params.get("window_chars", 500), params.get("min_occurrences", 1)
    near = lambda raw: lambda p: T.cut(raw, p - w, p + len(a) + w).contains(b)
    count = lambda ps: T.let(T.coded(x.low), lambda raw: F.size(F.filter(ps, near(raw))))
    n = T.let(T.positions(x.low, a), lambda ps: F.struct(F.size(ps).alias("all"), F.when((F.size(ps) > 0) & x.low.contains(b), count(ps)).otherwise(0).alias("near")))
    return T.let(n, lambda k: F.when(k["all"] == 0, verdict(NOT_APPLICABLE, _head(x), strings([]), f"{a} not present")).when(k["near"] >= least, verdict(PASSED, T.fragment(x.text, x.low, [a, b]), strings([F.lit(a), F.lit(b)]), F.concat(k["near"].cast("string"), F.lit(" joint occurrences")))).otherwise(verdict(FAILED, T.fragment(x.text, x.low, [a]), strings([F.lit(a)]), F.concat(k["near"].cast("string"), F.lit(" joint occurrences")))))


@condition("definition_contains")
def definition_contains(params: dict, x: Text) -> Column:
    concept, required = (params.get("concept") or "").lower(), [t.lower() for t in params.get("required_terms", [])]
    if not concept or not required:
        return verdict(NOT_APPLICABLE, _head(x), strings([]), "no concept or terms")
    w, least = params.get("window_chars", 400), params.get("min_ratio", 0.5)
    share = lambda raw: lambda p: T.let(T.cut(raw, p - w, p + len(concept) + w), lambda s: sum((s.contains(t).cast("int") for t in required), F.lit(0)) / float(len(required)))
    highest = lambda ps: T.let(T.coded(x.low), lambda raw: F.array_max(F.transform(ps, share(raw))))
    best = T.let(T.positions(x.low, concept), lambda ps: F.struct(F.size(ps).alias("all"), F.when(F.size(ps) > 0, highest(ps)).otherwise(0.0).alias("best")))
    return T.let(best, lambda k: F.when(k["all"] == 0, verdict(NOT_APPLICABLE, _head(x), strings([]), f"{concept} not present")).otherwise(verdict(F.when(k["best"] >= least, PASSED).otherwise(FAILED), T.fragment(x.text, x.low, [concept]), strings([F.lit(concept)]), F.concat(F.lit("best share of terms "), k["best"].cast("string")))))


@condition("topic_coverage")
def topic_coverage(params: dict, x: Text) -> Column:
    words = list(params.get("source_keywords", []))
    if not words:
        return verdict(NOT_APPLICABLE, _head(x), strings([]), "no keywords")
    found = those(words, lambda t: x.low.contains(t.lower()))
    ok = F.size(found) / float(len(words)) >= params.get("min_coverage_ratio", 0.5)
    return verdict(F.when(ok, PASSED).otherwise(FAILED), _head(x), found, F.concat(F.size(found).cast("string"), F.lit(f" of {len(words)} keywords")))


@condition("term_coverage_check")
def term_coverage_check(params: dict, x: Text) -> Column:
    groups = params.get("entity_groups") or {}
    if not groups:
        return verdict(NOT_APPLICABLE, _head(x), strings([]), "no groups")
    found = F.filter(strings([F.when(_any([x.text.contains(t) for t in ts]), F.lit(g)) for g, ts in groups.items()]), lambda g: g.isNotNull())
    ok = F.size(found) >= params.get("min_entity_groups_present", 1)
    return verdict(F.when(ok, PASSED).otherwise(FAILED), _head(x), found, F.concat(F.size(found).cast("string"), F.lit(" groups present")))


@condition("ast_check")
def ast_check(params: dict, x: Text) -> Column:
    """No parser is available here, and without one there are no hits: passed."""
    return verdict(PASSED, _head(x), strings([]), "no parser, so no hits")


def _compare(operator: str, value: float, expected: float, default: str) -> bool:
    ops = {">=": value >= expected, "<=": value <= expected, ">": value > expected, "<": value < expected, "==": value == expected, "!=": value != expected}
    return ops.get(operator, ops[default])


def number_of(text: str, params: dict) -> tuple[str, float | None, str]:
    """(status, value, raw) of a numeric rule on one text.

    The region around the match of the context with most numbers of the unit (at equal counts, the one
    whose number is strictly nearer) is searched first, then the text. Of several numbers the first one
    with the least distance after a match start counts, else the nearest; positions of numbers are those
    in the region, positions of matches those in the text.
    """
    import re

    unit, years = params.get("unit", "年"), "年" in (params.get("accept_units") or ())
    pattern, place = params.get("context_pattern") or "", text
    starts: list[int] = []
    if pattern:
        try:
            found = list(re.finditer(pattern, text))
        except re.error:
            pattern, found = "", None
        if found is not None:
            if not found:
                return NOT_APPLICABLE, None, ""
            starts = [m.start() for m in found]
            best = (0, float("inf"), 0, 0)
            for m in found:
                low, high = max(0, m.start() - 200), min(len(text), m.end() + 200)
                here = numbers(text[low:high])
                same = [n for n in here if n[1] == unit]
                count = len(same) or (sum(n[1] == "年" for n in here) if unit == "月" and years else 0)
                near = min((abs(n[3] - (m.start() - low)) for n in same), default=float("inf"))
                if count > best[0] or (count == best[0] and count > 0 and near < best[1]):
                    best = (count, near, low, high)
            if best[0]:
                place = text[best[2] : best[3]]
    all_numbers = numbers(place) or numbers(text)
    some = [n for n in all_numbers if n[1] == unit]
    if not some and unit == "月" and years:
        some = [(n[0] * 12, "月", f"{int(n[0] * 12)}月", n[3]) for n in all_numbers if n[1] == "年"]
    if not some:
        return NOT_APPLICABLE, None, ""
    pick = some[0]
    if starts and len(some) > 1:
        after = [(n[3] - s, i) for i, n in enumerate(some) for s in starts if n[3] >= s]
        around = [(abs(n[3] - s), i) for i, n in enumerate(some) for s in starts]
        pick = some[min(after or around)[1]]
    ok = _compare(params.get("operator", ">="), pick[0], float(params.get("expected", 0)), ">=")
    return (PASSED if ok else FAILED), pick[0], pick[2]


def sum_of(text: str, params: dict) -> tuple[str, float | None, str]:
    """(status, total, raw) of a summed rule: numbers of the unit from 300 characters before the first match to 300 after the last."""
    import re

    unit, pattern, place = params.get("unit", "%%"), params.get("context_pattern", "%%"), text
    if pattern:
        try:
            found = list(re.finditer(pattern, text))
        except re.error:
            found = []
        if found:
            place = text[max(0, found[0].start() - 300) : found[-1].end() + 300]
    some = [n for n in numbers(place) if n[1] == unit] or [n for n in numbers(text) if n[1] == unit]
    if not some:
        return NOT_APPLICABLE, None, ""
    total = sum(n[0] for n in some)
    operator = params.get("operator", "<=")
    ok = total >= float(params.get("expected", 100)) if operator == ">=" else total <= float(params.get("expected", 100))
    return (PASSED if ok else FAILED), total, ", ".join(n[2] for n in some[:5])


_FOUND = pa.struct([("status", pa.string()), ("value", pa.float64()), ("raw", pa.string())])


def _numeric_udf(params: dict, of: Callable):
    found = lambda t: dict(zip(("status", "value", "raw"), of(t, params), strict=True))

    @F.arrow_udf("struct<status:string,value:double,raw:string>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield each_once(texts, found, _FOUND)

    return run


def may_have(text: Column, unit: str | None, years: bool = False) -> Column:
    """Whether a text can have a number of a unit at all: where it can't, a numeric rule is not applicable."""
    if not unit:
        return F.lit(True)
    others = ["百分之", "万分之"] * (unit == "%") + ["年"] * (unit == "月" and years)
    return _any([text.contains(s) for s in (unit, *others)])


def _numeric(params: dict, x: Text, of: Callable) -> Column:
    # texts that can't have such a number don't go to Python
    able = may_have(x.text, params.get("unit", "年" if of is number_of else "%%"), "年" in (params.get("accept_units") or ()))
    found = _numeric_udf(params, of)(F.when(able, x.text))
    raw = F.when(found["raw"] != "", F.array(found["raw"])).otherwise(strings([]))
    return verdict(found["status"], F.when(found["status"] == NOT_APPLICABLE, _head(x)).otherwise(found["raw"]), raw, F.concat(F.lit(f"{params.get('label', '')} value "), F.coalesce(found["value"].cast("string"), F.lit("none"))))


@condition("numeric_comparison")
def numeric_comparison(params: dict, x: Text) -> Column:
    return _numeric(params, x, number_of)


@condition("sum_numeric_comparison")
def sum_numeric_comparison(params: dict, x: Text) -> Column:
    return _numeric(params, x, sum_of)


def compiled(rule: Rule, x: Text, contract_type: Column | None = None, value: Column | None = None, scope: Text | None = None) -> Column:
    """The verdict expression of a rule, behind its gates: excluded contract types, least value, purchase wording.

    With a `scope`, the rule reads that part of the text, and is not applicable where it is missing.
    """
    build = HANDLERS.get(rule.condition_type)
    out = build(rule.params, scope or x) if build else verdict(NOT_APPLICABLE, x.text, strings([]), f"unknown condition type {rule.condition_type}")
    if scope is not None and build:
        out = F.when(scope.text.isNull(), verdict(NOT_APPLICABLE, _head(x), strings([]), f"no clause of type {rule.clause_type}")).otherwise(out)
    skip = lambda why: verdict(NOT_APPLICABLE, _head(x), strings([]), why)
    gates = []
    if rule.exclude_contract_types and contract_type is not None:
        gates.append((F.coalesce(contract_type.isin(*rule.exclude_contract_types), F.lit(False)), "contract type excluded"))
    if rule.min_contract_value > 0 and value is not None:
        gates.append((F.coalesce((value > 0) & (value < rule.min_contract_value), F.lit(False)), "contract value too small"))
    if "购销合同" in rule.exclude_contract_types:
        gates.append((x.full.contains("买受方") & x.full.contains("出卖方"), "purchase wording"))
    for holds, why in reversed(gates):
        out = F.when(holds, skip(why)).otherwise(out)
    return out


def with_text(docs: DataFrame, text_col: str = "text", full_col: str | None = None) -> tuple[DataFrame, Text]:
    """The documents with the text columns that conditions share, computed once for each row."""
    full_col = full_col or text_col
    body = F.coalesce(F.col(text_col), F.lit(""))
    full = F.coalesce(F.col(full_col), F.lit(""))
    out = docs.withColumns({"_text": body, "_low": F.lower(body), "_full": full, "_full_low": F.lower(full), "_markers": T.has_markers(full)})
    return out, Text(*(F.col(c) for c in ("_text", "_low", "_full", "_full_low", "_markers")))


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", contract_type: Column | None = None, value: Column | None = None, keep: tuple[str, ...] = (), scopes: str | None = None) -> DataFrame:
    """(id, `keep`, verdicts): one row for each document, with an array of (rule_ix, rule_id, package_id, v) in rule order.

    `scopes` names a column with a map of clause types to texts (see clauses.with_scopes): a rule with a
    clause type then reads the clauses of this type alone, in documents that have clauses. What compares
    verdicts of one document works on this row, without a join or a shuffle.
    """
    ship(docs.sparkSession)
    base, x = with_text(docs, text_col)
    kinds = sorted({r.clause_type for r in rules if r.clause_type}) if scopes else []
    parts, by_kind = [], {}
    for i, kind in enumerate(kinds):
        body = F.when(F.size(F.coalesce(F.col(scopes), F.create_map().cast("map<string,string>"))) == 0, F.col("_text")).otherwise(F.try_element_at(scopes, F.lit(kind)))
        base = base.withColumn(f"_text_{i}", body).withColumn(f"_low_{i}", F.lower(f"_text_{i}"))
        by_kind[kind] = Text(F.col(f"_text_{i}"), F.col(f"_low_{i}"), x.full, x.full_low, x.markers)
    for ix, r in enumerate(rules):
        v = compiled(r, x, contract_type, value, by_kind.get(r.clause_type))
        parts.append(F.struct(F.lit(ix).alias("rule_ix"), F.lit(r.id).alias("rule_id"), F.lit(r.package_id).alias("package_id"), v.alias("v")))
    return base.select(id_col, *keep, F.array(*parts).alias("verdicts"))


def evaluate(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", contract_type: Column | None = None, value: Column | None = None, keep: tuple[str, ...] = (), scopes: str | None = None) -> DataFrame:
    """Evidence: one row for each document and rule, in one pass over the documents (see judged).

    Columns: the id, those in `keep`, rule_ix, rule_id, rule_name, rule_version, package_id,
    package_version, severity, status, input_fragment, matched_terms, rationale, category, source_type,
    source_credibility, extraction_method, legal_hierarchy. Null texts are empty ones.
    """
    # explode_outer, as explode would have Spark compute the array once more to see whether it is empty
    rows = judged(docs, rules, id_col, text_col, contract_type, value, keep, scopes).select(id_col, *keep, F.explode_outer("verdicts").alias("e"))
    rows = rows.select(id_col, *keep, "e.rule_ix", "e.v.status", F.col("e.v.fragment").alias("input_fragment"), "e.v.matched_terms", "e.v.rationale")
    meta = docs.sparkSession.createDataFrame([(i, r.id, r.name or r.id, r.version, r.package_id, r.package_version, r.severity, r.category, r.source, float(r.source_credibility), r.extraction_method, r.legal_hierarchy) for i, r in enumerate(rules)], "rule_ix int, rule_id string, rule_name string, rule_version string, package_id string, package_version string, severity string, category string, source_type string, source_credibility double, extraction_method string, legal_hierarchy string")
    return rows.join(F.broadcast(meta), "rule_ix").select(id_col, *keep, "rule_ix", "rule_id", "rule_name", "rule_version", "package_id", "package_version", "severity", "status", "input_fragment", "matched_terms", "rationale", "category", "source_type", "source_credibility", "extraction_method", "legal_hierarchy")
