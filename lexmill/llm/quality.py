"""Quality classifier: boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._boosting import Trees, fit
from ._common import read
from ._shingles import PIECE_BYTES, word_hashes

#: Labelled rows that the trees are fitted on, at most; which ones depends on a hash of the id alone.
TRAIN_ROWS = 20_000
#: Characters whose shares are statistics of their own.
MARKS = "|#$%&*!.,;:-_=<>/\\\"'()[]{}@"
FEATURES = ["log_bytes", "log_words", "word_mean", "word_sd", "upper", "lower", "digit", "space", "newline", "non_ascii", "punct", "entropy", "log_lines", "line_mean", "same_lines", "distinct_words", "top_word", "distinct_pairs", *(f"mark_{ord(c)}" for c in MARKS)]
_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_BYTES >= ord(a)) & (_BYTES <= ord(b)) for a, b in ("AZ", "az", "09"))
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_MARKS = np.array([ord(c) for c in MARKS])


def statistics(text: str | None) -> np.ndarray:
    """The statistics named in FEATURES for one whole text; all 0 for null and empty texts."""
    out = np.zeros(len(FEATURES), np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return out
    count = sum(np.bincount(raw[i : i + PIECE_BYTES], minlength=256) for i in range(0, len(raw), PIECE_BYTES))
    n, share = len(raw), count / len(raw)
    gaps = np.concatenate([[-1], np.flatnonzero(_SPACE[raw]), [n]])
    length = np.diff(gaps) - 1
    length = length[length > 0]
    words = word_hashes(text)
    _, times = np.unique(words, return_counts=True)
    pairs = words[1:] * np.uint64(31) + words[:-1]
    lines = [x for x in text.split("\n") if x.strip()]
    some = share[share > 0]
    out[:18] = [
        np.log1p(n), np.log1p(len(length)), length.mean() if len(length) else 0, length.std() if len(length) else 0,
        share[_UPPER].sum(), share[_LOWER].sum(), share[_DIGIT].sum(), share[_SPACE].sum(), share[10], share[128:].sum(), share[_PUNCT].sum(),
        -(some * np.log2(some)).sum(), np.log1p(len(lines)), n / (len(lines) + 1), 1 - len(set(lines)) / len(lines) if lines else 0,
        len(times) / len(words) if len(words) else 0, times.max() / len(words) if len(words) else 0, len(np.unique(pairs)) / len(pairs) if len(pairs) else 1,
    ]
    out[18:] = share[_MARKS]
    return out


def _statistics_udf():
    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([statistics(t) for t in texts])

    return run


def _score_udf(trees: Trees):
    @F.pandas_udf("double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            x = np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)), np.float32)
            yield pd.Series(np.concatenate([trees.score(x[i : i + 1000]) for i in range(0, len(x), 1000)] or [np.empty(0)]))

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of fitting: crc32 of the id as text is divisible by 5 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most `train_rows` labelled rows that aren't held out; rows with a null id or label are left out.

    Of documents that share an id one is fitted on, with the text that sorts first; labels that repeat an id count each.
    """
    ship(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().where(~held_out(F.col("_id")))
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "_y").limit(train_rows)  # bounded, so it can be broadcast
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(sample.select("_id").distinct()), "_id", "left_semi")
    texts = found.groupBy("_id").agg(F.min("_text").alias("_text"))  # no more rows than the sample
    rows = texts.join(F.broadcast(sample), "_id").select(_statistics_udf()(F.col("_text")).alias("x"), "_y", "_id").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    rows = rows.sort_values(["_id", "_y"], kind="stable")
    return fit(np.stack(rows["x"].to_numpy()), rows["_y"].to_numpy())


def with_score(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of `docs`, and the probability of good quality.

    Each whole text is scored; null and empty texts have statistics of 0 and the score that these get.
    Equal texts have equal scores. Only the text goes into a score. An existing column of the score's
    name is replaced.
    """
    ship(docs.sparkSession)
    return docs.withColumn(score_col, _score_udf(trees)(F.col(text_col)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, read(spark, sf_dir, "labels"))).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
