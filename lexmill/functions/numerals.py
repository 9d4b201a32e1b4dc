"""Numbers written in Arabic or Chinese numerals, as Column expressions and (for R7/R8) batch functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Numerals and units.
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SCALES = {"十": 10, "百": 100, "千": 1000, "万": 10000}
FORMAL_DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
FORMAL_SCALES = {"十": 10, "百": 100, "千": 1000, "仟": 1000, "拾": 10, "佰": 100}
SECTIONS = {"万": 10000, "亿": 100000000, "萬": 10000, "億": 100000000}
AMOUNT_CHARS = "壹贰叁肆伍陆柒捌玖一二三四五六七八九十百千万亿零元整仟拾佰萬億"
NUMERAL_CHARS = "零一二两三四五六七八九十百千万亿"
UNITS = "年|月|日|天|元|万|%|％"
NEXT_UNITS = "年月日天元个百分点"


def _lookup(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(c == k, F.lit(float(v))).otherwise(out)
    return out


def numeral(s: Column, adding: bool = False) -> Column:
    """A whole number from Arabic digits or Chinese numerals; null when it isn't one or isn't positive.

    A digit replaces the one before it (or, with `adding`, is added to it); a scale of ten or more
    multiplies what came before, one if nothing did, and adds it to the total. Arabic zero stays 0.
    """
    s = F.trim(s)
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("digit"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        digit, scale = _lookup(ch, DIGITS), _lookup(ch, SCALES)
        times = F.when(acc["digit"] == 0, 1.0).otherwise(acc["digit"])
        return F.struct(
            F.when(scale.isNotNull(), acc["total"] + times * scale).otherwise(acc["total"]).alias("total"),
            F.when(scale.isNotNull(), 0.0).when(digit.isNotNull(), digit + acc["digit"] if adding else digit).otherwise(acc["digit"]).alias("digit"),
            (acc["ok"] & (scale.isNotNull() | digit.isNotNull())).alias("ok"),
        )

    value = lambda a: F.when(a["ok"] & (a["total"] + a["digit"] > 0), (a["total"] + a["digit"]).cast("long"))
    folded = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), zero, step, value)
    return F.when(s.rlike(r"^[+-]?[0-9]{1,18}$"), s.try_cast("long")).when(s != "", folded)


def amount_run(run: Column) -> Column:
    """The value of a run of amount characters: digits add up, scales close a part, sections multiply what came before."""
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("total", "part", "digit")))

    def step(acc: Column, ch: Column) -> Column:
        d, u, b = _lookup(ch, FORMAL_DIGITS), _lookup(ch, FORMAL_SCALES), _lookup(ch, SECTIONS)
        scaled = acc["part"] + F.when(acc["digit"] == 0, 1.0).otherwise(acc["digit"]) * u
        return (
            F.when(d.isNotNull(), F.struct(acc["total"].alias("total"), acc["part"].alias("part"), (acc["digit"] + d).alias("digit")))
            .when(u.isNotNull(), F.struct(acc["total"].alias("total"), scaled.alias("part"), F.lit(0.0).alias("digit")))
            .when(b.isNotNull(), F.struct((acc["total"] + (acc["part"] + acc["digit"]) * b).alias("total"), F.lit(0.0).alias("part"), F.lit(0.0).alias("digit")))
            .otherwise(acc)
        )

    chars = F.filter(F.split(F.regexp_replace(run, "[元整]+$", ""), ""), lambda c: c != "")
    return F.aggregate(chars, zero, step, lambda a: a["total"] + a["part"] + a["digit"])


def contract_value(text: Column) -> Column:
    """Yuan: the first N万元, else the first N亿元, else the largest amount in Chinese numerals."""
    first = lambda unit: F.regexp_extract(text, rf"(?U)(\d+(?:\.\d+)?)\s*{unit}", 1).try_cast("double")
    wan, yi = first("万元"), first("亿元")
    arabic = F.when(wan.isNotNull(), F.floor(wan * 10000)).when(yi.isNotNull(), F.floor(yi * 100000000)).otherwise(0).cast("long")
    runs = F.filter(F.split(text, f"[^{AMOUNT_CHARS}]+"), lambda r: r != "")
    spelled = F.coalesce(F.floor(F.array_max(F.transform(runs, amount_run))).cast("long"), F.lit(0).cast("long"))
    return let(arabic, lambda a: F.when(a != 0, a).otherwise(spelled))


def to_chinese(n: Column) -> Column:
    """Chinese numeral of 1 to 999; other numbers as they are."""
    digit = lambda d: F.element_at(F.array(*(F.lit(c) for c in "一二三四五六七八九")), d)
    h, t, o = (n / 100).cast("int"), (n % 100 / 10).cast("int"), (n % 10).cast("int")
    ones = F.when(o > 0, digit(F.greatest(o, F.lit(1)))).otherwise("")
    tens = F.when((t == 1) & (h == 0), F.concat(F.lit("十"), ones)).when(t > 0, F.concat(digit(F.greatest(t, F.lit(1))), F.lit("十"), ones)).when((h > 0) & (o > 0), F.concat(F.lit("零"), ones)).otherwise(ones)
    return F.when((n >= 1) & (n <= 999), F.concat(F.when(h > 0, F.concat(digit(F.greatest(h, F.lit(1))), F.lit("百"))).otherwise(""), tens)).otherwise(n.cast("string"))


# ---- batch form, used inside Arrow UDFs for the numeric rules ----

_VALUES = DIGITS | SCALES
_ARABIC = re.compile(rf"(\d+(?:\.\d+)?)\s*({UNITS})")
_PERCENT = re.compile("百分之([零一二两三四五六七八九十百千万]+)")
_PERMYRIAD = re.compile("万分之([零一二两三四五六七八九十百千万]+)")
_SPELLED = re.compile(f"[{NUMERAL_CHARS}]+")


def parse_numeral(s: str) -> int | None:
    """The value that numeral() gives, for one string."""
    s = s.strip()
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    total = held = 0
    for ch in s:
        v = _VALUES.get(ch)
        if v is None:
            return None
        total, held = (total + (held or 1) * v, 0) if v >= 10 else (total, v)
    return total + held if s and total + held > 0 else None


def numbers(text: str) -> list[tuple[float, str, str, int]]:
    """(value, unit, raw, position) of all numbers: Arabic with a unit, N per cent, N per ten thousand (in
    per cent), then any run of numerals with the unit that follows. The passes may find the same characters."""
    out = [(float(m[1]), m[2], m[0], m.start()) for m in _ARABIC.finditer(text)]
    for pattern, scale in ((_PERCENT, 1.0), (_PERMYRIAD, 0.01)):
        out += [(float(v) * scale, "%", m[0], m.start()) for m in pattern.finditer(text) if (v := parse_numeral(m[1])) is not None]
    for m in _SPELLED.finditer(text):
        if (v := parse_numeral(m[0])) is not None:
            after = text[m.end() : m.end() + 1]
            unit = after if after and after in NEXT_UNITS else ""
            out.append((float(v), unit, m[0] + unit, m.start()))
    return out
