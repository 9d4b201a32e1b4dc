"""Domains on disk: manifests, rule packages, ontologies, texts; and writers of results.

Files are found and read by Spark, so folders can be in any store that Spark reads.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule
from ..shipping import ship

# Which predicate a condition type needs on a domain's whitelist.
PREDICATES = {
    "required_pattern": "must_contain", "forbidden_pattern": "must_not_contain", "mutual_exclusion": "mutually_exclusive", "co_occurrence": "co_occurs", "logical_chain": "implies", "scope_constraint": "scoped",
    "numeric_comparison": "numeric_compare", "sum_numeric_comparison": "numeric_sum", "contextual_co_occurrence": "context", "definition_contains": "defines", "topic_coverage": "covers",
}
MANIFEST = "id string, name string, version string, description string, maintainer string, disclaimer string, predicate_whitelist array<string>, files map<string,string>"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, id, name, version, ..., files): every domain.json below a folder, those in folders that begin with _ left out."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "domain.json").json(root)
    out = rows.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), "/domain.json$", ""))
    return out.where(~F.col("path").rlike("/_[^/]*(/|$)"))


def resolve(domains: DataFrame, name: str) -> DataFrame:
    """The domains of an id, or of a path that ends with a name with slashes."""
    return domains.where(F.col("path").endswith("/" + name.strip("/"))) if "/" in name else domains.where((F.col("id") == name) | F.col("path").endswith("/" + name))


# Names of package files, if a manifest doesn't give any.
PACKAGE_FILES = ("rules.json", "general-contract.json", "main-contract.json")


def package_files(spark: SparkSession, folder: str, files: dict) -> list[str]:
    """Paths of a domain's package files that exist: those in the list of its manifest, else the one it names, else files of known names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(names) -> list[str]:
        paths = [f"{folder}/{n}" for n in names if n]
        return [p for p in paths if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]

    declared = files.get("rules_packages") or []
    return there([declared] if isinstance(declared, str) else declared) or there([files.get("rules_package")]) or there(PACKAGE_FILES)


class Packages:
    """The packages of a session by id: what rules are evaluated is what is loaded here."""

    def __init__(self) -> None:
        self._held: dict[str, list[Rule]] = {}

    @staticmethod
    def checked(rules: list[Rule]) -> list[Rule]:
        """The rules, if all of their patterns are regular expressions; a context that is none is left out when its rule is evaluated."""
        for r in rules:
            try:
                re.compile(r.params.get("pattern") or "", re.IGNORECASE)
            except re.error as e:
                raise ValueError(f"rule {r.id}: its pattern is no regular expression: {e}") from e
        return rules

    def load(self, package_id: str, rules: list[Rule]) -> None:
        """Add a package; one that is loaded already is an error."""
        if package_id in self._held:
            raise ValueError(f"package {package_id} is loaded already")
        self._held[package_id] = self.checked(rules)

    def reload(self, package_id: str, rules: list[Rule]) -> None:
        """Replace a package that is loaded."""
        if package_id not in self._held:
            raise KeyError(package_id)
        self._held[package_id] = self.checked(rules)

    def unload(self, package_id: str) -> None:
        """Take a package away, if it is there."""
        self._held.pop(package_id, None)

    def listed(self) -> list[tuple[str, int]]:
        """(id, number of rules) in the order of loading."""
        return [(k, len(v)) for k, v in self._held.items()]

    def rules(self) -> list[Rule]:
        """All rules, package by package."""
        return [r for held in self._held.values() for r in held]


def load_rules(spark: SparkSession, path: str, whitelist: list[str] | None = None) -> list[Rule]:
    """The rules of a package file, which is an object with rules or a bare list.

    With a whitelist, a rule whose type has no predicate on it is an error, as is an unknown type.
    """
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one file
    data = json.loads(text)
    package = data if isinstance(data, dict) else {"id": "candidate", "rules": data}
    out = []
    for r in package.get("rules", []):
        c = dict(r.get("condition", {}))
        kind = c.pop("type", "")
        if whitelist is not None and PREDICATES.get(kind) not in whitelist:
            raise ValueError(f"rule {r.get('id')}: condition type {kind!r} is not on the domain's whitelist")
        scope = r.get("scope") or {}
        out.append(Rule(r["id"], kind, c, r.get("name", r["id"]), r.get("severity", "warning"), r.get("category", ""), package.get("id", ""), package.get("version", "1"), r.get("version", "1"), r.get("source", ""), float(r.get("source_credibility", 0.5)), r.get("extraction_method", "manual"), r.get("clause_type"), r.get("legal_hierarchy", ""), tuple(scope.get("exclude_contract_types") or ()), float(scope.get("min_contract_value") or 0)))
    return out


def load_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(group, gpos, term) of an ontology file's entity groups."""
    rows = spark.read.schema("entity_groups map<string,array<string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("entity_groups").alias("group", "terms")).select("group", F.posexplode("terms").alias("gpos", "term")).select("group", F.col("gpos").cast("long").alias("gpos"), "term")


def load_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """(surface, canonical) of a global ontology: an object of concepts with canonical names and surfaces."""
    rows = spark.read.schema("concepts map<string,struct<canonical:string,surfaces:array<string>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("concepts").alias("concept", "c")).select(F.explode("c.surfaces").alias("surface"), F.col("c.canonical").alias("canonical"))


def load_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text): each text file below a folder, whole."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def load_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF files, by a library that has to be installed on the executors; null text without it."""
    ship(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)

    @F.udf("string")
    def pages(content: bytes) -> str | None:
        try:
            from io import BytesIO

            from pypdf import PdfReader
        except ImportError:
            return None
        return "\n".join(p.extract_text() or "" for p in PdfReader(BytesIO(content)).pages)

    return rows.select("path", pages("content").alias("text"))


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, rule_id, text, expected_status, ...): labelled samples, as JSON lines or one array."""
    return spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)


def write_tiers(rows: DataFrame, path: str, tier_col: str = "tier") -> None:
    """Rows as JSON, a folder for each tier."""
    rows.write.mode("overwrite").partitionBy(tier_col).json(path)


def write_evidence_index(evidence: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Evidence of each document as one JSON object of rule to statuses."""
    pairs = evidence.groupBy(id_col, "rule_id").agg(F.array_sort(F.collect_set("status")).alias("statuses"))
    index = pairs.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "statuses")))).alias("rules"))
    index.write.mode("overwrite").json(path)


def write_domain(spark: SparkSession, path: str, manifest: dict, rules: list[dict], groups: dict[str, list[str]]) -> None:
    """A domain folder as discover() finds it: the files domain.json, rules.json and ontology.json, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    for name, data in (("domain", manifest), ("rules", {"id": manifest["id"], "rules": rules}), ("ontology", {"entity_groups": groups})):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.json")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(json.dumps(data, ensure_ascii=False, indent=1).encode()))
        out.close()
