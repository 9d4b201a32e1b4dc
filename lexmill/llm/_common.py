"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Keys that hold at least this share of the rows of a join count as hot; so at most its inverse are.
HOT_SHARE = 1 / 256
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ensure_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder: the one of spark.checkpoint.dir, or one in the warehouse, which is shared as well."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the reliable checkpoint folder and without lineage.

    The folder is the one that the cluster names in spark.checkpoint.dir; where that is unset, one in
    the warehouse.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    _ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a DataFrame as a table in the shared folder, for large steps: tables are
    compressed, which checkpoints needn't be. The tables go at the end of the block."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_folder(spark, "table"))
        df.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            remove_folder(spark, path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, A_Z, A_Z.lower())


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def hot_rows(n: int) -> float:
    """How many of n rows a hot key has at least."""
    return max(1000, n * HOT_SHARE)


def join_keyed(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join `left` to `right`, which has one row for each key, however often one key occurs in `left`.

    Keys that hold HOT_SHARE of left's rows or more are counted first - 256 at most, a bound that holds
    at any size - and their rows of `right` are broadcast; all other rows are shuffled as usual. Rows
    with a null key match nothing and stay when `how` is "left". `left` is read more than once, so it
    should be a table or a checkpoint. A caller that knows the hot keys gives them as `hot`, with the
    columns of `keys`.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if hot is None:
        counts = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
        hot = counts.where(F.col("_n") >= hot_rows(left.count())).select(*keys)
    rows = hot.collect()
    if not rows:
        return left.join(right, keys, how)
    known = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    warm = left.join(known, keys, "left_anti").join(right, keys, how)
    return left.join(known, keys, "left_semi").join(F.broadcast(right.join(known, keys, "left_semi")), keys, how).unionByName(warm)


def free(name: str, df: DataFrame) -> str:
    """A name like `name` that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_sha(text_col: str = "text") -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", sha_col: str = "sha") -> DataFrame:
    """The rows of `docs`, with all their columns, whose id and text are not those of a row of `dropped`.

    Ids can be null or repeated: other texts of an id stay. Spark broadcasts a small `dropped`.
    """
    sha, id_, gone = free("_sha", docs), free("_id", docs), free("_gone", docs)
    keys = dropped.select(F.col(id_col).alias(id_), F.col(sha_col).alias(gone)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(gone))
    return docs.withColumn(sha, text_sha()).join(keys, same, "left_anti").drop(sha)


def without_repeats(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One of the rows that have equal ids (nulls are equal) and equal texts."""
    sha = free("_sha", docs)
    return docs.withColumn(sha, text_sha()).dropDuplicates([id_col, sha]).drop(sha)
