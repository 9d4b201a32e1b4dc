"""A text classifier of TF-IDF weights and multinomial Naive Bayes, kept as tables, with a fallback for unsure predictions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import characters
from ..shipping import ship
from .graph import reliable

# Lengths of n-grams, smoothing, the share of texts from which an n-gram is too common, the least sure probability.
LOW, HIGH, ALPHA, MOST_TEXTS, LEAST_SURE = 1, 3, 1.0, 0.95, 0.25
UNKNOWN = "unknown"
#: Rows of a table of n-grams that are broadcast at most, those of the most common ones; the others are joined by a shuffle.
HOT = 400_000
#: Bits of a character in the number of an n-gram, which holds up to three.
BITS = 21
#: Characters whose n-grams a worker hands on at once, or a text with more.
CHUNK = 1_000_000


def numbered(gram: Column) -> Column:
    """The number of an n-gram: code points and 1, the first one lowest; no two n-grams share one."""
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long") + 1
    return F.aggregate(F.reverse(characters(gram)), F.lit(0).cast("long"), lambda a, c: a * (1 << BITS) + code(c))


def spelled(number: Column) -> Column:
    """The n-gram of a number."""
    code = lambda i: F.shiftrightunsigned(number, i * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.concat(*(F.when(code(i) > 0, F.decode(F.unhex(F.lpad(F.hex(code(i) - 1), 8, "0")), "UTF-32")).otherwise("") for i in range(HIGH)))


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all different character n-grams of a text, and how often each occurs."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
    every = np.sort(np.concatenate([sum(codes[i : len(codes) - k + 1 + i] << (BITS * i) for i in range(k)) for k in range(LOW, min(HIGH, len(codes)) + 1)] or [codes]))
    starts = np.flatnonzero(np.diff(every, prepend=0))
    return every[starts], np.diff(starts, append=len(every))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *_, texts = batch.columns
        sizes, at = np.cumsum(pc.utf8_length(texts).to_numpy()), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
            found = [_grams(t.as_py()) for t in texts[at:upto]]
            ends = pa.array(np.cumsum([0, *(len(g) for g, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind)) for parts, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([c[at:upto] for c in batch.columns[:-1]] + lists, names=[*batch.schema.names[:-1], "grams", "counts"])
            at = upto


def counted(texts: DataFrame, id_col: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., grams, counts): the character n-grams of each text in lower case, with blanks squeezed, and how often each occurs.

    N-grams are counted text by text in a task, so their rows aren't shuffled; only if ids repeat, the counts of their rows are put together.
    """
    ship(texts.sparkSession)
    by = [id_col, *keep]
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s\s+", " ")
    rows = texts.select(*by, clean.alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(_count, f"{kinds}, grams array<long>, counts array<int>")
    if texts.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found
    sums = _each(found, *by).groupBy(*by, "gram").agg(F.sum("n").cast("int").alias("n"))
    whole = sums.groupBy(*by).agg(F.collect_list(F.struct("gram", "n")).alias("g"))
    return whole.select(*by, F.col("g.gram").alias("grams"), F.col("g.n").alias("counts"))


def _each(rows: DataFrame, *cols: str) -> DataFrame:
    """(cols..., gram, n): a row for each n-gram of counted texts."""
    return rows.select(*cols, F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("n"))))


def _tf() -> Column:
    return 1 + F.log(F.col("n").cast("double"))


def _joined(each: DataFrame, table: DataFrame, kinds: int = 1) -> DataFrame:
    """`each` with the rows of `table` (gram, df, ...), up to `kinds` for an n-gram.

    N-grams with a df of at least `least` are broadcast: they are HOT / kinds at most, as all df add up to HOT / kinds times that.
    So no task gets the rows of a common n-gram; the rarer ones, if there are any, are joined by a shuffle.
    """
    n, total = table.select("gram", "df").distinct().agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    if n * kinds <= HOT:
        return each.join(F.broadcast(table.drop("df")), "gram")
    common = F.col("df") >= total * kinds / HOT
    hot = F.broadcast(table.where(common).drop("df"))
    rare = each.join(F.broadcast(hot.select("gram").distinct()), "gram", "left_anti").join(table.where(~common).drop("df"), "gram")
    return each.join(hot, "gram").unionByName(rare)


@dataclass(frozen=True)
class TfIdfModel:
    """idf: (gram, df, idf); lift: (class, gram, lift), how much more than `base` an n-gram that a class has weighs; classes: (class, prior, base)."""

    idf: DataFrame
    lift: DataFrame
    classes: DataFrame

    def save(self, path: str) -> None:
        for name in ("idf", "lift", "classes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TfIdfModel:
        return TfIdfModel(*(spark.read.parquet(f"{path}/{name}") for name in ("idf", "lift", "classes")))


def train(texts: DataFrame, id_col: str, class_col: str, text_col: str = "text") -> TfIdfModel:
    """The model of labelled texts; rows of a class that share an id count as one text, rows without a class are left out.

    N-grams that more than MOST_TEXTS of all texts have are dropped. An n-gram that a class doesn't have weighs the same
    for all of them, so only those it has are kept for it.
    """
    known = texts.where(F.col(class_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(class_col).cast("string").alias("class"), F.col(text_col).alias("text"))
    sizes = reliable(known.groupBy("class").agg(F.count("*").alias("n")))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    rows = reliable(counted(known, "id", "text", ("class",)))
    df = rows.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") <= MOST_TEXTS * n)
    idf = reliable(df.select("gram", "df", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    size = idf.count()
    w = _tf() * F.col("idf")
    norms = _joined(_each(rows, "id"), idf).groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    # a text's weights over their Euclidean length add up without the idf, which is the same for all rows of an n-gram
    shares = _each(rows.join(norms, "id"), "class", "norm").groupBy("class", "gram").agg(F.sum(_tf() / F.col("norm")).alias("share"))
    sums = reliable(shares.join(idf, "gram").select("class", "gram", (F.col("share") * F.col("idf")).alias("s")))
    totals = sizes.join(sums.groupBy("class").agg(F.sum("s").alias("total")), "class", "left")
    spread = F.log(F.coalesce("total", F.lit(0.0)) + ALPHA * size)
    classes = reliable(totals.select("class", F.log(F.col("n") / F.lit(float(max(n, 1)))).alias("prior"), (F.log(F.lit(ALPHA)) - spread).alias("base")))
    return TfIdfModel(idf.withColumn("gram", spelled(F.col("gram"))), sums.select("class", spelled(F.col("gram")).alias("gram"), (F.log(F.col("s") + ALPHA) - F.log(F.lit(ALPHA))).alias("lift")), classes)


def probabilities(model: TfIdfModel, texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, class, probability) of every class for every text; without any known n-gram, the classes' shares."""
    ids = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    idf = model.idf.select("gram", numbered(F.col("gram")).alias("number"), "df", "idf")
    # an n-gram has a row for its weight, without a class, and one for each class that has it
    entries = idf.withColumn("class", F.lit(None).cast("string")).withColumn("lift", F.lit(1.0)).unionByName(idf.join(model.lift, "gram"))
    known = reliable(entries.select(F.col("number").alias("gram"), "df", "idf", "class", "lift"))
    w = _tf() * F.col("idf")
    sums = _joined(_each(counted(ids, "id"), "id"), known, model.classes.count() + 1).groupBy("id", "class").agg(F.sum(w * F.col("lift")).alias("s"), F.sqrt(F.sum(w * w)).alias("norm"))
    # a row for each class and text, of which there are few
    found = sums.groupBy("id").agg(F.max(F.when(F.col("class").isNull(), F.col("norm"))).alias("norm"), F.max(F.when(F.col("class").isNull(), F.col("s"))).alias("all"), F.map_from_entries(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "s")))).alias("lifted"))
    classes = model.classes.agg(F.collect_list(F.struct("class", "prior", "base")).alias("c"))
    every = ids.select("id").join(found, "id", "left").join(F.broadcast(classes)).where(F.size("c") > 0)
    score = lambda c: c["prior"] + F.coalesce((F.col("all") * c["base"] + F.coalesce(F.col("lifted")[c["class"]], F.lit(0.0))) / F.col("norm"), F.lit(0.0))
    top = every.select("id", F.transform("c", lambda c: F.struct(c["class"].alias("class"), score(c).alias("score"))).alias("s"))
    best = F.array_max(F.transform("s", lambda c: c["score"]))
    odds = F.transform("s", lambda c: F.struct(c["class"].alias("class"), F.exp(c["score"] - best).alias("p")))
    total = F.aggregate(odds, F.lit(0.0), lambda a, c: a + c["p"])
    return top.select(F.col("id").alias(id_col), F.explode(F.transform(odds, lambda c: F.struct(c["class"].alias("class"), (c["p"] / total).alias("probability")))).alias("c")).select(id_col, "c.*")


def predict(model: TfIdfModel, texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, class, probability) of the most probable class, ties by name; a model without classes gives UNKNOWN."""
    p = probabilities(model, texts, id_col, text_col).groupBy(id_col).agg(F.min(F.struct((-F.col("probability")).alias("k"), "class")).alias("m"))
    return texts.select(id_col).join(p, id_col, "left").select(id_col, F.coalesce("m.class", F.lit(UNKNOWN)).alias("class"), (-F.col("m.k")).alias("probability"))


def with_fallback(predicted: DataFrame, other: DataFrame, id_col: str, least: float = LEAST_SURE) -> DataFrame:
    """(id, class, probability, source): predictions, with the class of `other` (id, class) where one is less probable than `least` and the other knows one."""
    rows = predicted.join(other.select(id_col, F.col("class").alias("_other")), id_col, "left")
    weak = (F.coalesce("probability", F.lit(0.0)) < least) & F.col("_other").isNotNull()
    return rows.select(id_col, F.when(weak, F.col("_other")).otherwise(F.col("class")).alias("class"), "probability", F.when(weak, "fallback").otherwise("model").alias("source"))
