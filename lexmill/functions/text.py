"""Text functions as Column expressions: tokens, n-grams, positions, fragments, negation contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character ranges that count as CJK; fixed value.
CJK = "㐀-䶿一-鿿豈-﫿"
#: The narrower range used where only common ideographs count.
HAN = "一-鿿"

# Markers of negation, permission and obligation around a term.
NEGATION = "不得|禁止|不应|不能|不可|严禁|不许|不准|切勿|不得将|不允许"
PERMISSION = "可低于|可不|可以低于|可以不|有权|须垫|必须垫|应当垫|需垫|应予垫|由.*垫"
OBLIGATION = "应当|必须|应对|应当|应按|应由|应在|应向|应于|应经"
REFUSAL = "不另行|不单独|不包含|不出具|不再出具|不另出具|不予出具|不提供|不另提供|不单独提供|不签订|不另签订|不另行签订|不约定|不另约定|不得|禁止|不应|不能|不可|严禁|不许|不准|不允许"
CLAUSE_BREAKS = "，,。；;！!\n：:、"


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def is_cjk(term: str) -> bool:
    return bool(term) and all("㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" for c in term)


def has_term(low: Column, term: str) -> Column:
    """Whether `term` is one of the lower-case text's tokens or of its runs of up to three tokens.

    Windows of one to six ideographs inside a run are tokens, so such a term only has to occur; Latin
    terms have to be one to three whole words, with neither words nor ideographs between them. Nothing
    else ever matches. The pattern begins with the term itself, and ends at its first whole occurrence.
    """
    t = term.lower()
    words = t.split(" ")
    if is_cjk(t):
        return low.contains(t) if len(t) <= 6 else F.lit(False)
    if 1 <= len(words) <= 3 and all(w and all(c.isascii() and (c.isalnum() or c == "_") for c in w) for w in words):
        first, *rest = words
        after = "".join(f"[^a-z0-9_{CJK}]+{w}" for w in rest)
        return low.rlike(f"{first}(?<![a-z0-9_]{first}){after}(?![a-z0-9_])")
    return F.lit(False)


def runs(text: Column) -> Column:
    """Maximal runs of ideographs or of [a-z0-9_] in the lower-case text, in order."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"([{CJK}]+)|[^a-z0-9_{CJK}]+", " $1 ")
    return F.filter(F.split(spaced, " +"), lambda r: r != "")


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def windows(s: Column, low: int, high: int) -> Column:
    """Substrings of `low` to `high` characters, shorter ones first.

    They are put together from the array of characters: a substring of a long string has to be found
    from its start each time.
    """
    none = F.array().cast("array<string>")

    def of(chars: Column, k: int) -> Column:
        n = F.size(chars)
        if k == 1:
            return chars
        if k == 2:
            pairs = F.zip_with(F.slice(chars, 1, F.greatest(n - 1, F.lit(0))), F.slice(chars, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
            return F.when(n >= 2, pairs).otherwise(none)
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(chars, i, k), ""))).otherwise(none)

    return let(characters(s), lambda chars: F.flatten(F.array(*(of(chars, k) for k in range(low, high + 1)))))


def tokens(text: Column) -> Column:
    """Tokens in order: Latin words; each ideograph of a run, then its windows of 2 to 6 characters."""
    return F.flatten(F.transform(runs(text), lambda r: F.when(r.rlike(f"^[{CJK}]"), windows(r, 1, 6)).otherwise(F.array(r))))


def token_ngrams(toks: Column, n: int = 3) -> Column:
    """The set of tokens and of sequences of up to n tokens joined by spaces."""
    size = F.size(toks)
    seqs = [_sequences(toks, size, k) for k in range(2, n + 1)]
    return F.array_distinct(F.concat(toks, *seqs))


def _sequences(toks: Column, size: Column, k: int) -> Column:
    joined = lambda i: F.array_join(F.slice(toks, i, k), " ")
    return F.when(size >= k, F.transform(F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1))), joined)).otherwise(F.array().cast("array<string>"))


def han_only(text: Column) -> Column:
    """The ideographs of a text, all else removed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{HAN}]", "")


def han_ngrams(text: Column, low: int, high: int) -> Column:
    """N-grams over the joined ideographs, so they cross punctuation."""
    return let(han_only(text), lambda s: windows(s, low, high))


def bigrams(text: Column, letters: bool = False) -> Column:
    """The set of character bigrams over joined ideographs, or over joined lower-case letters."""
    base = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", "") if letters else han_only(text)
    return F.array_distinct(let(base, lambda s: windows(s, 2, 2)))


def gram_hash(gram: Column) -> Column:
    """A number of 31 bits for an n-gram, h = 31 h + code point; of three characters with bit 32 set, so that they differ from pairs.

    Characters outside the basic plane count with their code point. Different n-grams can share a number:
    where that matters, group by the n-gram itself.
    """
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    h = F.aggregate(F.transform(characters(gram), code), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0x7FFFFFFF))
    return F.when(F.char_length(gram) == 3, h.bitwiseXOR(F.lit(0x80000000))).otherwise(h)


def gram_counts(text: Column, k: int) -> Column:
    """Array of (gram, n): how often each k-gram occurs over the joined ideographs of a text, sorted by gram."""

    def counted(g: Column) -> Column:
        starts = F.filter(F.transform(g, lambda x, i: F.when((i == 0) | (x != F.get(g, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(g, i).alias("gram"), (F.coalesce(F.get(at, j + 1), F.size(g)) - i).alias("n"))))

    return let(F.array_sort(let(han_only(text), lambda s: windows(s, k, k))), counted)


def overlaps_itself(term: str) -> bool:
    return any(term.startswith(term[i:]) for i in range(1, len(term)))


def running(values: Column, chunk: int = 256) -> Column:
    """For each number of an array, the sum of those before it.

    Sums are taken in chunks, and each chunk's start from the chunks before it, so the work grows much
    slower than with the square of the length.
    """
    add = lambda a, x: a + x
    upto = lambda c: F.transform(c, lambda _, i: F.aggregate(F.slice(c, 1, i), F.lit(0), add))
    chunks = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(c) / chunk).cast("int") - 1)), lambda i: F.slice(c, i * chunk + 1, chunk))
    whole = lambda cs: upto(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), add)))
    spread = lambda cs: let(whole(cs), lambda starts: F.flatten(F.transform(cs, lambda c, i: F.transform(upto(c), lambda x: x + F.get(starts, i)))))
    return let(values, lambda c: let(chunks(c), spread))


def positions(text: Column, term: str) -> Column:
    """0-based start of every occurrence of a literal term.

    Found by splitting at the term and adding up the lengths before each cut, in one pass. A term that
    can overlap itself stays whole: the text is split where it begins.
    """
    none = F.array().cast("array<int>")
    if not term:
        return none
    if overlaps_itself(term):
        # cut before each occurrence; there is no cut before the text's first character
        found = let(F.split(text, f"(?={_quoted(term)})", -1), lambda parts: running(F.transform(parts, lambda p: F.length(p))))
        return F.when(text.contains(term), F.filter(found, lambda p: (p > 0) | text.startswith(term))).otherwise(none)
    # what stands before the n-th cut, and the n terms between
    starts = lambda parts: F.slice(running(F.transform(parts, lambda p: F.length(p) + len(term))), 2, F.size(parts) - 1)
    found = F.transform(let(F.split(text, _quoted(term), -1), starts), lambda p: p - len(term))
    return F.when(text.contains(term), found).otherwise(none)


def coded(text: Column) -> Column:
    """The text in four bytes for each character, so that a part of it is found at once (see cut)."""
    return F.encode(text, "UTF-32")


def places(raw: Column) -> Column:
    return (F.length(raw) / 4).cast("int")


def cut(raw: Column, start: Column, end: Column) -> Column:
    """Characters from `start` to `end` (0-based, exclusive) of a coded text, cut to the text as slices are."""
    low = F.greatest(start, F.lit(0))
    return F.decode(F.substring(raw, low * 4 + 1, F.greatest(F.least(end, places(raw)) - low, F.lit(0)) * 4), "UTF-32")


def _quoted(term: str) -> str:
    return "\\Q" + term + "\\E"


def between(text: Column, start: Column, end: Column) -> Column:
    """Characters from `start` to `end` (0-based, exclusive), cut to the text as slices are."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(F.least(end, F.length(text)) - low, F.lit(0)))


def fragment(text: Column, low: Column, terms: list[str], around: int = 100) -> Column:
    """The text around the first occurrences of the terms, with ... where it was cut; else its first 200 characters."""
    firsts = [F.locate(t.lower(), low) for t in terms if t]
    if not firsts:
        return F.substring(text, 1, 200)

    def marked(p: Column) -> Column:
        start, end = F.greatest(p["low"] - 1 - around, F.lit(0)), F.least(p["high"] - 1 + around, p["n"])
        cut_out = F.regexp_replace(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))), r"(?U)^\s+|\s+$", "")
        return F.concat(F.when(start > 0, "...").otherwise(""), cut_out, F.when(end < p["n"], "...").otherwise(""))

    spots = let(F.array(*firsts), lambda ps: let(F.filter(ps, lambda i: i > 0), lambda q: F.struct(F.array_min(q).alias("low"), F.array_max(q).alias("high"), F.length(text).alias("n"))))
    return let(spots, lambda p: F.when(p["low"].isNull(), F.substring(text, 1, 200)).otherwise(marked(p)))


def has_markers(low: Column) -> Column:
    """Whether a text can have a marker of negation, obligation or refusal at all: they are all ideographs."""
    return low.rlike(f"[{HAN}]")


def mostly_negated(low: Column, term: str, window: int = 50, markers: Column | None = None) -> Column:
    """Whether at least half of a term's occurrences (and one) stand near a negation or an obligation.

    A permission within the window makes an occurrence count as not negated.
    """
    t = term.lower()
    n = len(t)

    def negated(raw: Column, p: Column) -> Column:
        around, before, after = cut(raw, p - window, p + n + window), cut(raw, p - window, p), cut(raw, p + n, p + n + window)
        return ~around.rlike(PERMISSION) & (before.rlike(NEGATION) | after.rlike(NEGATION) | around.rlike(OBLIGATION))

    share = let(positions(low, t), lambda ps: let(coded(low), lambda raw: let(F.size(F.filter(ps, lambda p: negated(raw, p))), lambda k: (k > 0) & (k * 2 >= F.size(ps)))))
    # most texts have no such marker at all
    return F.when((has_markers(low) if markers is None else markers) & low.rlike(f"{NEGATION}|{OBLIGATION}"), F.coalesce(share, F.lit(False))).otherwise(F.lit(False))


def always_refused(low: Column, term: str, window: int = 50, markers: Column | None = None) -> Column:
    """Whether every occurrence of a term follows a refusal by at most five characters of the same clause."""
    t = term.lower()
    n = len(t)

    def refused(raw: Column, p: Column) -> Column:
        before = cut(raw, p - window, p)
        tail = F.regexp_extract(before, f"(?s)^.*(?:{REFUSAL})(.*?)$", 1)
        has = before.rlike(REFUSAL)
        return ~cut(raw, p - window, p + n + window).rlike(PERMISSION) & has & (F.length(tail) <= 5) & ~tail.rlike(f"[{CLAUSE_BREAKS}]")

    every = let(positions(low, t), lambda ps: let(coded(low), lambda raw: (F.size(ps) > 0) & (F.size(F.filter(ps, lambda p: refused(raw, p))) == F.size(ps))))
    return F.when((has_markers(low) if markers is None else markers) & low.rlike(REFUSAL), F.coalesce(every, F.lit(False))).otherwise(F.lit(False))
