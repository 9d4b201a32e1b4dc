"""Token counts, and rollups of them that batches of changes keep up to date."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import cut, read, remove_folder, shared_folder
from .mixing import word_count

TOKENIZERS = "/opt/tokenizers"
#: How a text is cut before pairs are merged; fixed value of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]


def bpe_count(text: Column, vocabulary: str) -> Column:
    """Tokens of each whole text in a byte-level vocabulary of ranks (a .tiktoken file that the driver reads)."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @F.pandas_udf("long")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in it:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return run(text)


class TokenRollup:
    """Additive totals of documents and tokens by source, language and tokenizer version.

    A batch of changes is reduced to signed sums per key, written aside and moved to a folder of its own,
    named by the batch. The first commit of a batch counts: a batch that is there already, or in the
    snapshot, is left as it is, so redelivery and retries change nothing. Totals are the sums over the snapshot and all
    batches since. compact() folds these batches into a new snapshot with a table of their names. One process
    at a time commits and compacts; totals() may run beside them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(n for n in names if n.startswith(prefix) and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def _state(self) -> tuple[str | None, list[str]]:
        """The last snapshot and the batches that it doesn't hold, from one listing.

        Batches are deleted at the second compaction after they were committed, so no more are listed than that.
        """
        if not self._fs.exists(self._at("")):
            return None, []
        # batches first: one that is folded meanwhile is in the snapshot listed after it, and its name with it
        batches = self._complete("batch-")
        last = (self._complete("snapshot-") or [None])[-1]
        held = self._held(last, [b.removeprefix("batch-") for b in batches])
        return last, [b for b in batches if b.removeprefix("batch-") not in held]

    def _held(self, snapshot: str | None, batches: list[str]) -> set[str]:
        """Those of `batches` that the snapshot holds."""
        if snapshot is None or not batches:
            return set()
        names = self.spark.read.parquet(f"{self.path}/{snapshot.replace('snapshot', 'batches')}")
        return {r[0] for r in names.where(F.col("batch").isin(batches)).collect()}

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Apply changes: rows of KEYS with old_tokens and new_tokens.

        An insert has no old count, a delete no new one, a revision both; a row with neither changes
        nothing. Null keys are values of their own. Deletes and revisions of documents that were never
        inserted make totals negative: changes are trusted, as they are only added up.
        """
        name = f"batch-{batch}"
        if self._fs.exists(self._at(f"{name}/_SUCCESS")) or self._held((self._complete("snapshot-") or [None])[-1], [batch]):
            return
        old, new = F.col("old_tokens"), F.col("new_tokens")
        signed = changes.select(*KEYS, (new.isNotNull().cast("long") - old.isNotNull().cast("long")).alias("docs"), (F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("tokens"))
        aside = f"try-{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{aside}")
        self._fs.delete(self._at(name), True)  # what a broken move has left
        if not self._fs.rename(self._at(aside), self._at(name)):
            raise OSError(f"{name} could not be put in its place")

    def _sums(self, last: str | None, batches: list[str]) -> DataFrame:
        names = batches + ([last] if last else [])
        if not names:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        rows = self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens): one row for each key that still has documents or tokens."""
        return self._sums(*self._state())

    def compact(self) -> None:
        """Fold all batches into a snapshot; their names go first, so a snapshot is never without them.

        The names and the sums are of one listing: a batch committed meanwhile is in neither. What is folded stays
        until the next compaction, as does the snapshot before: totals() that were asked for earlier and
        are read only now still find their files. What was folded the last time goes.
        """
        last, fresh = self._state()
        if not fresh:
            return
        n = int(last.rpartition("-")[2]) + 1 if last else 0
        folded = self._held(last, [b.removeprefix("batch-") for b in self._complete("batch-")])
        names = self.spark.createDataFrame([(b.removeprefix("batch-"),) for b in fresh], "batch string")
        if last:
            names = names.unionByName(self.spark.read.parquet(f"{self.path}/{last.replace('snapshot', 'batches')}"))
        names.write.mode("overwrite").parquet(f"{self.path}/batches-{n:08d}")
        self._sums(last, fresh).write.mode("overwrite").parquet(f"{self.path}/snapshot-{n:08d}")
        for b in folded:
            self._fs.delete(self._at(f"batch-{b}"), True)
        for old in self._complete("snapshot-"):
            if last and old < last:
                self._fs.delete(self._at(old), True)
                self._fs.delete(self._at(old.replace("snapshot", "batches")), True)


def counted(docs: DataFrame, tokenizers: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, words, marked_words, bpe) of every row: counts of each whole text.

    words are separated by white space; of marked_words, every character but letters, digits, _ (of
    ASCII) and white space is one by itself; bpe counts tokens of a byte-level vocabulary. Null and empty texts have none.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.regexp_replace(text, r"([^\s\w])", " $1 ")
    marked = F.size(F.filter(F.split(spaced, r"\s+"), lambda w: w != "")).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), word_count(text).alias("words"), marked.alias("marked_words"), bpe_count(text, f"{tokenizers}/byte_bpe_multi_50k.tiktoken").alias("bpe"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents counted in words; all counted in BPE; the word counts of all revised;
    documents labelled as of bad quality deleted from both. The third batch is delivered twice."""
    docs = cut(counted(read(spark, sf_dir, "documents")))
    bad = read(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    gone = docs.join(bad, "doc_id", "left_semi")
    none = F.lit(None).cast("long")
    change = lambda df, tokenizer, old, new: df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), old.alias("old_tokens"), new.alias("new_tokens"))
    path = shared_folder(spark, "rollup")
    rollup = TokenRollup(spark, path)
    rollup.commit("0001", change(docs, "words", none, F.col("words")))
    rollup.commit("0002", change(docs, "bpe-50k", none, F.col("bpe")))
    rollup.compact()
    for _ in range(2):
        rollup.commit("0003", change(docs, "words", F.col("words"), F.col("marked_words")))
    rollup.commit("0004", change(gone, "words", F.col("marked_words"), none).unionByName(change(gone, "bpe-50k", F.col("bpe"), none)))
    out = cut(rollup.totals())
    remove_folder(spark, path)
    return out


QUERIES = {"op6_tokens": op6_tokens}
ORACLES: dict[str, str] = {}
