"""Stores that learn between runs: candidate prototypes and running centroids, in versions that a replay doesn't change.

A store is a folder. A version is a set of tables under `version=N`, and a marker `DONE-N` that is written last: readers take the
newest version that is marked, so a job that dies leaves the store as it was. A version names the batches
it holds; a batch that is applied again is skipped. The version before stays readable for those who have
opened it; older ones go. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import remove
from .graph import reliable

# Thresholds of prototypes, how far one has to lead, likeness of suggestions, verdicts that count.
LEAST_COVERAGE, DEFAULT_COVERAGE, LEAST_COMBINED, LEAD, LIKENESS = 0.005, 0.01, 0.001, 2.0, 0.5
GOOD, BAD = ("PASSED", "ALL_PASSED"), ("FAILED", "CONFLICTED")


class Versions:
    """The versions of a store's tables."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables | {"batches": "batch string"}

    def _folder(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        _, at, files = self._folder()
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"DONE-(\d+)", n))), default=0)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        v = self.version() if version is None else version
        if not v:
            return {t: self.spark.createDataFrame([], schema) for t, schema in self.tables.items()}
        return {t: self.spark.read.schema(schema).parquet(f"{self.path}/version={v}/{t}") for t, schema in self.tables.items()}

    def apply(self, batch: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> bool:
        """Writes what `change` makes of the tables as the next version; False if the batch is in the store already."""
        now = self.version()
        tables = self.read(now)
        if not tables["batches"].where(F.col("batch") == batch).isEmpty():
            return False
        new = tables | change(tables)
        new["batches"] = tables["batches"].unionByName(self.spark.createDataFrame([(batch,)], "batch string"))
        for name in self.tables:
            new[name].write.mode("overwrite").parquet(f"{self.path}/version={now + 1}/{name}")  # of a job that died before its marker
        jvm, _, files = self._folder()
        files.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/DONE-{now + 1}"), True).close()
        if now > 1:
            remove(self.spark, f"{self.path}/version={now - 1}")
        return True


class PrototypeStore(Versions):
    """Candidate domains: the n-grams of each, how many samples they come from, and how its texts fared."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, {"grams": "domain string, gram string", "samples": "domain string, samples long", "usage": "domain string, n long, passed long, failed long"})

    def upsert(self, batch: str, grams: DataFrame, samples: DataFrame) -> bool:
        """Adds (domain, gram) and (domain, samples): new domains are registered, known ones take in the n-grams and add the samples."""

        def change(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
            known = t["grams"].unionByName(grams.select("domain", "gram")).distinct()
            counts = t["samples"].unionByName(samples.select("domain", F.col("samples").cast("long").alias("samples")))
            return {"grams": known, "samples": counts.groupBy("domain").agg(F.sum("samples").alias("samples"))}

        return self.apply(batch, change)

    def merge(self, batch: str, pairs: DataFrame) -> bool:
        """Folds (source, target) domains together: the target gets the source's n-grams, samples and usage. A target that is itself a source, or isn't known, is an error."""
        known = self.read()["samples"].select("domain")
        wrong = pairs.select(F.explode(F.array("source", "target")).alias("domain")).distinct().join(known, "domain", "left_anti")
        chained = pairs.select(F.col("target").alias("source")).join(pairs.select("source"), "source", "left_semi")
        if not self.read()["batches"].where(F.col("batch") == batch).isEmpty():
            return False
        if not wrong.isEmpty() or not chained.isEmpty():
            raise KeyError("merging needs known domains, and targets that aren't merged themselves")

        def change(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
            renamed = lambda df: df.join(pairs.withColumnRenamed("source", "domain"), "domain", "left").withColumn("domain", F.coalesce("target", "domain")).drop("target")
            sums = lambda df: df.groupBy("domain").agg(*(F.sum(c).alias(c) for c in df.columns if c != "domain"))
            return {"grams": renamed(t["grams"]).distinct(), "samples": sums(renamed(t["samples"])), "usage": sums(renamed(t["usage"]))}

        return self.apply(batch, change)

    def remove(self, batch: str, domains: list[str]) -> bool:
        return self.apply(batch, lambda t: {k: t[k].where(~F.col("domain").isin(domains)) for k in ("grams", "samples", "usage")})

    def record(self, batch: str, verdicts: DataFrame) -> bool:
        """Adds how texts of domains fared: (domain, verdict), a row each."""

        def change(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
            seen = verdicts.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("verdict").isin(*GOOD)).alias("passed"), F.count_if(F.col("verdict").isin(*BAD)).alias("failed"))
            return {"usage": t["usage"].unionByName(seen).groupBy("domain").agg(*(F.sum(c).alias(c) for c in ("n", "passed", "failed")))}

        return self.apply(batch, change)

    def domains(self) -> DataFrame:
        """(domain, samples, size, threshold, uses, pass_rate) of each prototype.

        The threshold is what leaving out one part of the sorted n-grams at a time gives: parts share none, so it is the
        least one, and the default for a single sample.
        """
        t = self.read()
        sized = t["grams"].groupBy("domain").agg(F.count("*").alias("size"))
        several = (F.col("samples") > 1) & (F.coalesce("size", F.lit(0)) > 1)
        rows = t["samples"].join(sized, "domain", "left").join(t["usage"], "domain", "left")
        rate = F.when(F.col("n") > 0, F.round(F.col("passed") / F.col("n"), 3)).otherwise(0.0)
        return rows.select("domain", "samples", F.coalesce("size", F.lit(0)).alias("size"), F.when(several, LEAST_COVERAGE).otherwise(DEFAULT_COVERAGE).alias("threshold"), F.coalesce("n", F.lit(0)).alias("uses"), rate.alias("pass_rate"))

    def classify(self, rows: DataFrame, id_col: str) -> DataFrame:
        """(id, domain, coverage) of texts given as distinct (id, gram): the best domain that reaches its threshold if it leads by LEAD or is alone, else all that do."""
        from . import classify as K

        t = self.read()
        cover = K.coverage(rows.withColumnRenamed("gram", "bigram"), t["grams"].withColumnRenamed("gram", "bigram"), id_col)
        above = cover.join(self.domains().select("domain", "threshold"), "domain").where("coverage >= threshold")
        listed = above.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("k"), "domain"))).alias("all"))  # one row for each domain
        first, second = -F.get("all", F.lit(0))["k"], F.coalesce(-F.get("all", F.lit(1))["k"], F.lit(0.0))
        chosen = F.when(first >= second * LEAD, F.slice("all", 1, 1)).otherwise(F.col("all"))
        return listed.select(id_col, F.explode(chosen).alias("c")).select(id_col, "c.domain", (-F.col("c.k")).alias("coverage"))

    def suggest(self, least: float = LIKENESS) -> DataFrame:
        """(a, b, likeness) of different domains whose sets of n-grams have a Jaccard similarity of `least` or more: candidates for a merge."""
        g = self.read()["grams"]
        sizes = g.groupBy("domain").agg(F.count("*").alias("n"))
        both = g.select("gram", F.col("domain").alias("a")).join(g.select("gram", F.col("domain").alias("b")), "gram").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
        sized = both.join(sizes.select(F.col("domain").alias("a"), F.col("n").alias("n1")), "a").join(sizes.select(F.col("domain").alias("b"), F.col("n").alias("n2")), "b")
        return sized.select("a", "b", (F.col("k") / (F.col("n1") + F.col("n2") - F.col("k"))).alias("likeness")).where(F.col("likeness") >= least)


class Centroids(Versions):
    """Running means of vectors by class: sums and counts, which add up to the same however rows are split to batches.

    Components are summed as decimals, so that no order of addition shows in the result.
    """

    SCALE = "decimal(38,15)"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, {"sums": f"class string, pos int, total {self.SCALE}, n long"})

    def add(self, batch: str, vectors: DataFrame, class_col: str, vector_col: str) -> bool:
        parts = vectors.select(F.col(class_col).cast("string").alias("class"), F.posexplode(vector_col).alias("pos", "x"))
        parts = parts.groupBy("class", "pos").agg(F.sum(F.col("x").cast("double").cast(self.SCALE)).cast(self.SCALE).alias("total"), F.count("*").alias("n"))
        return self.apply(batch, lambda t: {"sums": t["sums"].unionByName(parts).groupBy("class", "pos").agg(F.sum("total").cast(self.SCALE).alias("total"), F.sum("n").alias("n"))})

    def means(self) -> DataFrame:
        """(class, n, centroid): the mean of all vectors added so far."""
        rows = self.read()["sums"].groupBy("class").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", (F.col("total").cast("double") / F.col("n")).alias("x")))).alias("c"))
        return rows.select("class", "n", F.transform("c", lambda s: s["x"]).alias("centroid"))

    def nearest(self, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """(id, class, distance): the class whose mean is nearest by the hybrid distance."""
        from .clusters import match

        table = reliable(self.means().select(F.col("class").alias("cluster"), "centroid"))
        found = match(vectors.select(id_col, F.transform(vector_col, lambda x: x.cast("double")).alias("vector")), table, id_col)
        return found.withColumnRenamed("cluster", "class")
