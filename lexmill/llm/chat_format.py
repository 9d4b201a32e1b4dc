"""Chat formatting with Spark expressions only: collect, sort, merge, concatenate, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import running
from ._common import cut, let, read

# The template: a block for each run of turns of one role. Escaped texts hold no "<" and no "[", so
# neither these marks nor those of other templates (</s>, [INST]) can occur in them.
ROLE, ROLE_END, NEXT, END = "<|role:", "|>", "<|next|>", "<|end|>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_ESCAPES = [*ESCAPES, ("|", "&#124;")]


def escape(c: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def merged(turns: Column) -> Column:
    """Runs of adjacent turns of one role in a sorted array of turns: array of (role, texts)."""
    starts = lambda t: F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x["role"] != F.get(t, i - 1)["role"]), i)), lambda i: i.isNotNull())
    run = lambda t, s, i, j: F.struct(F.get(t, i)["role"].alias("role"), F.transform(F.slice(t, i + 1, F.coalesce(F.get(s, j + 1), F.size(t)) - i), lambda x: x["text"]).alias("texts"))
    return let(turns, lambda t: let(starts(t), lambda s: F.transform(s, lambda i, j: run(t, s, i, j))))


def under_spans(text: Column, spans: Column) -> Column:
    """The parts of a text in `spans` (start, end; code points): in a code of four bytes each, so that a part is found at once."""
    return let(F.encode(text, "UTF-32"), lambda raw: F.transform(spans, lambda s: F.decode(F.substring(raw, s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32")))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation: one string, and where the loss counts.

    Turns are sorted by turn number, then role and text; adjacent turns of one role share a block, with
    a mark between their texts, so that the single turns can be read back. loss_spans are the code point
    ranges (start, end exclusive) of the texts of `learned` roles in the formatted string.

    Null roles and texts count as empty; a null turn number sorts first; rows without a conversation id
    are one conversation. Repeated rows are turns of their own. A conversation is one value in the
    result, so its turns come together in one task; different conversations are independent. Columns of
    other names are ignored.
    """
    c = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), c(role_col).alias("role"), c(text_col).alias("text")).alias("t"))
    blocks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", merged(F.col("turns")).alias("blocks"))
    block = lambda b: F.concat(F.lit(ROLE), escape(b["role"], ROLE_ESCAPES), F.lit(ROLE_END), F.array_join(F.transform(b["texts"], lambda x: escape(x)), NEXT), F.lit(END))
    # one entry for each text: what stands before it, its length, whether it is learned, what stands after it
    entry = lambda b: F.transform(
        b["texts"],
        lambda x, i: F.struct(
            F.when(i == 0, F.length(escape(b["role"], ROLE_ESCAPES)) + len(ROLE + ROLE_END)).otherwise(len(NEXT)).alias("before"),
            F.length(escape(x)).alias("n"),
            b["role"].isin(*learned).alias("learned"),
            F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("after"),
        ),
    )

    entries = F.flatten(F.transform("blocks", entry))
    start = lambda e, at: at + e["before"]
    place = lambda t: F.transform(F.arrays_zip(t.alias("e"), running(F.transform(t, lambda e: e["before"] + e["n"] + e["after"])).alias("at")), lambda x: F.struct(start(x["e"], x["at"]).alias("start"), (start(x["e"], x["at"]) + x["e"]["n"]).alias("end"), x["e"]["learned"].alias("learned")))
    spans = F.transform(F.filter(let(entries, place), lambda x: x["learned"]), lambda x: F.struct(x["start"], x["end"]))
    return blocks.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: Column) -> Column:
    """The turns in a formatted string: array of (role, text), as they were before formatting."""
    body = lambda b: F.split(F.substring(b, F.locate(ROLE_END, b) + len(ROLE_END), F.length(b)), NEXT.replace("|", r"\|"))
    role = lambda b: unescape(F.substring(b, F.lit(len(ROLE) + 1), F.locate(ROLE_END, b) - len(ROLE) - 1), ROLE_ESCAPES)
    turns = lambda b: F.transform(body(b), lambda x: F.struct(role(b).alias("role"), unescape(x).alias("text")))
    blocks = F.filter(F.split(formatted, END.replace("|", r"\|")), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    chats = cut(format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)))
    turns = read_chats(F.col("formatted"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform(under_spans(F.col("formatted"), F.col("loss_spans")), lambda x: unescape(x)), "")
    out = chats.select("conv_id", turns.alias("turns"), under.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _replaced(c: str, pairs: list[tuple[str, str]]) -> str:
    for plain, code in pairs:
        c = f"replace({c}, '{plain}', '{code}')"
    return c


QUERIES = {"op7_chat": op7_chat}
ORACLES = {
    "op7_chat": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        p AS (
            SELECT *, role IS DISTINCT FROM lag(role) OVER w AS first, role IS DISTINCT FROM lead(role) OVER w AS last
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length({_replaced("text", ESCAPES)}) + CASE WHEN last THEN {len(END)} ELSE 0 END
                   + CASE WHEN first THEN {len(ROLE + ROLE_END)} + length({_replaced("role", ROLE_ESCAPES)}) ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
        FROM p GROUP BY conv_id"""
}
