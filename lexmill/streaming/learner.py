"""A learner that corrects itself from evidence as it arrives: signals from history, and weights, as keyed state of streams.

Two streams, so that each can be restarted by itself. The first keeps, for each text, how often it was
given which type and how often a correction was suggested; it writes every signal with the reason why it counts or not. The
second keeps the weight of each feature of each label and applies the accepted corrections in their order.
State is per key, so what a task holds does not grow with the number of texts or features it has seen
before; a restart goes on from the checkpoint, and files already read are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

# Limits of signals and steps of weights.
LEAST_CONFIDENCE, LEAST_TIMES, LEAST_SHARE, LEAST_ROWS = 0.60, 2, 0.67, 3
RATE, FROM_TARGET, TO_TARGET, PRIOR_STEP, FLOOR = 0.05, 1e-5, 0.01, 0.005, 1e-10
SIGNALS = {"terms": None, "inconsistent": 0.55, "boundary": 0.45}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = "ev_id long, ts timestamp, text_hash string, old_label string, suggested string, confidence double, signal string, times long, accepted boolean, grams array<string>"
WEIGHTS = "label string, gram string, steps long, log_prob double"


def _dominant(terms: Column, groups: dict[str, str]) -> Column:
    """Of the groups that terms belong to, (k, group) of the one with most of them; of several the first by name."""
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in (kv[0].lower(), kv[1])])
    found = F.filter(F.transform(terms, lambda t: F.try_element_at(table, F.lower(F.trim(t)))), lambda g: g.isNotNull())
    counted = F.transform(F.array_distinct(found), lambda g: F.struct((-F.size(F.filter(found, lambda x: x == g))).alias("k"), g.alias("group")))
    return F.array_min(counted)


def suggestions(evidence: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Evidence with what it suggests by itself: `by_terms`, another type with two matched terms or more and most of all, its `terms_confidence`; and `near_boundary`.

    `evidence` has (ev_id, ts, text_hash, clause_type, status, terms, boundary, label_source, grams); `boundary` is how
    near a failed row was to passing, null if it was not triaged as failed. `groups` is an ontology: the group of each term.
    """
    failed = F.col("status") == "FAILED"
    best = _dominant(F.col("terms"), groups)
    strong = failed & (F.length("clause_type") > 0) & (best["group"] != F.col("clause_type")) & (best["k"] <= -2)
    share = -best["k"] / F.size("terms")
    return evidence.select(
        "ev_id", "ts", F.coalesce("text_hash", F.lit("")).alias("text_hash"), F.coalesce("clause_type", F.lit("")).alias("clause_type"), F.coalesce("label_source", F.lit("")).alias("label_source"), "grams",
        F.when(strong, best["group"]).alias("by_terms"), F.when(strong, F.least(F.lit(0.85), 0.5 + share * 0.5)).alias("terms_confidence"),
        F.coalesce(failed & (F.col("boundary") < 0.5), F.lit(False)).alias("near_boundary"),
    )


class TextHistory(StatefulProcessor):
    """The types that a text was given, and how often each correction was suggested for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.types = handle.getMapState("types", "type string", "n long")
        self.corrections = handle.getMapState("corrections", "old string, suggested string", "n long")

    def _signals(self, row) -> Iterator[tuple[str, str, float, str]]:
        if row.by_terms is not None:
            yield row.clause_type, row.by_terms, row.terms_confidence, "terms"
        if row.text_hash and len(self.seen) > 1:
            (first, n), (second, _) = sorted(self.seen.items(), key=lambda x: (-x[1], x[0]))[:2]
            total = sum(self.seen.values())
            if total >= LEAST_ROWS and n / total < LEAST_SHARE:
                yield first, second, SIGNALS["inconsistent"], "inconsistent"
        if row.near_boundary:
            yield row.clause_type, "", SIGNALS["boundary"], "boundary"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(rows).sort_values(["ts", "ev_id"])
        self.seen = {k[0]: v[0] for k, v in self.types.iterator()}
        typed, suggested, out = set(), {}, []  # state is written once for all rows of a text
        for row in rows.itertuples(index=False):
            if row.text_hash and row.clause_type:
                self.seen[row.clause_type] = self.seen.get(row.clause_type, 0) + 1
                typed.add(row.clause_type)
            for old, new, confidence, signal in self._signals(row):
                times = 0
                if confidence >= LEAST_CONFIDENCE and new not in ("", old) and row.label_source != "ground_truth":
                    if (old, new) not in suggested:
                        suggested[old, new] = self.corrections.getValue((old, new))[0] if self.corrections.containsKey((old, new)) else 0
                    suggested[old, new] += 1
                    times = suggested[old, new]
                out.append((row.ev_id, row.ts, row.text_hash, old, new, confidence, signal, times, times >= LEAST_TIMES, row.grams))
        for kind in sorted(typed):
            self.types.updateValue((kind,), (self.seen[kind],))
        for pair, times in suggested.items():
            self.corrections.updateValue(pair, (times,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY.split(", ")])

    def close(self) -> None:
        pass


def signals(evidence: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Every signal of a stream (or table) of evidence, in the order of (ts, ev_id) of each text; see HISTORY.

    Three signals: matched terms of another group than the type; a text whose types vary, so far, with none at
    LEAST_SHARE; a failure near the boundary, which only asks for a look. A signal is accepted from the LEAST_TIMES-th
    time on that the same correction of the same text comes with enough confidence, unless its label was given by hand.
    Rows are counted one by one, so it makes no difference how they are split to micro-batches, as long as a text's rows arrive in
    order. Rows without a text's hash share one key, and have no history of types.
    """
    ship(evidence.sparkSession)
    rows = suggestions(evidence, groups)
    return rows.groupBy("text_hash").transformWithStateInPandas(TextHistory(), HISTORY, "Append", "None")


class LabelWeights(StatefulProcessor):
    """The weight of one feature of one label; the feature with an empty name is the label's prior."""

    def __init__(self, rate: float):
        self.rate = rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        import math

        self.math = math
        self.p = handle.getValueState("p", "p double, steps long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.p.update((self.math.exp(float(initialState["log_prob"].iloc[0])), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(rows).sort_values(["ts", "ev_id", "place"])
        if self.p.exists():  # what the model doesn't know isn't added
            p, steps = self.p.get()
            for towards in rows["towards"]:
                if key[1] == "":
                    p += (1 if towards else -1) * self.rate * PRIOR_STEP
                else:
                    p = p * (1 - self.rate) + self.rate * (TO_TARGET if towards else FROM_TARGET)
                p = max(p, FLOOR)
                steps += 1
            self.p.update((p, steps))
            yield pd.DataFrame([(key[0], key[1], steps, self.math.log(p))], columns=[c.split()[0] for c in WEIGHTS.split(", ")])

    def close(self) -> None:
        pass


def corrections(accepted: DataFrame) -> DataFrame:
    """(label, gram, ts, ev_id, place, towards): what accepted signals do to features: away from the old label, towards the suggested one."""
    both = F.array(F.struct(F.col("old_label").alias("label"), F.lit(False).alias("towards")), F.struct(F.col("suggested").alias("label"), F.lit(True).alias("towards")))
    grams = F.concat(F.array(F.lit("")), F.filter(F.coalesce("grams", F.array().cast("array<string>")), lambda g: g.isNotNull() & (g != "")))
    rows = accepted.where("accepted").select("ts", "ev_id", F.explode(both).alias("l"), grams.alias("grams"))
    return rows.select("ts", "ev_id", "l.label", "l.towards", F.posexplode("grams").alias("place", "gram"))


def weights(accepted: DataFrame, model: DataFrame, rate: float = RATE) -> DataFrame:
    """(label, gram, steps, log_prob): weights after each trigger that changed them; the one with most steps is the newest.

    `model` has (label, gram, log_prob), and a label's prior under an empty gram. Each occurrence of a feature in
    the text of an accepted signal moves its probability by `rate`: in the old label towards FROM_TARGET, in the suggested one
    towards TO_TARGET; priors move by a fixed step. Features that the model doesn't have stay out.
    """
    ship(accepted.sparkSession)
    start = model.groupBy("label", "gram")
    return corrections(accepted).groupBy("label", "gram").transformWithStateInPandas(LabelWeights(rate), WEIGHTS, "Update", "None", initialState=start)


def newest(model: DataFrame, changed: DataFrame) -> DataFrame:
    """(label, gram, log_prob) of a model after changes that a stream has written."""
    last = changed.groupBy("label", "gram").agg(F.max(F.struct("steps", F.col("log_prob").alias("new"))).alias("last"))
    return model.join(last, ["label", "gram"], "left").select("label", "gram", F.coalesce("last.new", "log_prob").alias("log_prob"))


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the state store on disk; the setting holds for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_learner(evidence: DataFrame, groups: dict[str, str], model: DataFrame, folder: str, rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """Work off what a stream of evidence has now: (signals, newest model). Called again with the same folder, it goes on from there.

    All new signals are one trigger of the second stream, as those of one feature come from many texts and have to be put in order.
    """
    spark = evidence.sparkSession
    use_keyed_state(spark)

    def work(df: DataFrame, name: str, mode: str) -> None:
        def add(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

        df.writeStream.foreachBatch(add).outputMode(mode).option("checkpointLocation", f"{folder}/{name}-log").trigger(availableNow=True).start().awaitTermination()

    work(signals(evidence, groups), "signals", "append")
    told = spark.readStream.schema(HISTORY).parquet(f"{folder}/signals")
    work(weights(told, model, rate), "weights", "update")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return read("signals", HISTORY), newest(model, read("weights", WEIGHTS))
