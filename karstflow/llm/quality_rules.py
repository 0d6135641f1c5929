"""Quality rules: a table of thresholds compiled into one projection (native: column expressions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends a word: the space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish, lower-cased.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not are this at from or an have "
    "der die das und in zu den ist von mit ein eine auf für nicht des dem sich es "
    "le la les de des et en un une que qui est pour dans du au il elle par sur "
    "el los las y del se con una su por no es lo como para"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a null measure passes."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The thresholds beside the base ones (20 words at least, 30 % of them in repeated windows at most).
RULES = (
    Rule("mean_word_length", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.30),
    Rule("exclamation_ratio", high=0.50),
    Rule("stop_word_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.50),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more.

    Windows are compared by 64-bit hash, built from the words' hashes by doubling: 1, 2, 4, 8 words. Only a document
    whose hashes repeat sorts them with their places; everything is linear or a sort, so that long texts stay cheap.
    """

    def pairs(h: Column, gap: int) -> Column:
        shifted = F.slice(h, F.lit(gap + 1), F.greatest(F.size(h) - gap, F.lit(0)))
        return let(shifted, lambda s: F.zip_with(F.slice(h, F.lit(1), F.size(s)), s, lambda a, b: F.xxhash64(a, b)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            return F.filter(F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda p: p.isNotNull())

        def length(places: Column) -> Column:
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        return let(placed, lambda s: let(F.sort_array(twice(s)), length))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda one: let(pairs(one, 1), lambda two: let(pairs(two, 2), lambda four: pairs(four, 4))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def _per_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        _repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def _per_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )


def measured(docs: DataFrame, text: str = "text", prefix: str = "_m_") -> DataFrame:
    """docs and two structs of counts of the whole text, {prefix}words and {prefix}lines, and plain counts
    {prefix}word_chars, {prefix}n_symbols and {prefix}n_exclamations. A null text counts as empty.

    The measures come out of a generator with one row, which the optimiser doesn't merge with what is done with them: a
    filter on them would otherwise compute every measure again for each rule that names it.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    with_word = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    measures = {
        "words": let(F.filter(F.split(t, _SPLIT), lambda w: w != ""), _per_words),
        "lines": let(with_word, _per_lines),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": count(SYMBOLS),
        "n_exclamations": count("!"),
    }
    return docs.select("*", F.inline(F.array(F.struct(*[c.alias(prefix + x) for x, c in measures.items()]))))


def _columns(prefix: str) -> dict[str, Column]:
    """Every measure that a rule may name."""
    words, lines = F.col(prefix + "words"), F.col(prefix + "lines")
    n = words["n_words"]
    of = lambda x, y: F.when(y > 0, x / y)
    return {
        "n_words": n,
        "word_chars": F.col(prefix + "word_chars"),
        "n_symbols": F.col(prefix + "n_symbols"),
        "n_dup_lines": lines["n_dup_lines"],
        "n_repeat_words": words["n_repeat_words"],
        "repeat_word_ratio": of(words["n_repeat_words"], n),
        "mean_word_length": of(F.col(prefix + "word_chars"), n),
        "symbol_ratio": of(F.col(prefix + "n_symbols"), n),
        "exclamation_ratio": of(F.col(prefix + "n_exclamations"), n),
        "stop_word_ratio": of(words["n_stop_words"], n),
        "dup_line_ratio": of(lines["n_dup_lines"], lines["n_lines"]),
    }


def verdict(rules: tuple[Rule, ...], columns: dict[str, Column]) -> Column:
    """True if every rule holds: the threshold table as one expression."""
    good = F.lit(True)
    for r in rules:
        x = columns[r.measure]
        if r.low is not None:
            good = good & F.coalesce(x >= r.low, F.lit(True))
        if r.high is not None:
            good = good & F.coalesce(x <= r.high, F.lit(True))
    return good


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row.

    base_failed: n_words < 20 or 100 * n_repeat_words > 30 * n_words, in whole numbers. kept: not base_failed and every
    rule of the table holds. A null or empty text has no words and fails; a text of any length is judged whole, in linear
    time but for the sort of its windows' hashes; repeated rows are judged each for itself; an empty table gives an empty
    result; other columns are ignored whatever their names.
    """
    rows = measured(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    c = _columns("_m_")
    failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    return rows.select(
        "doc_id",
        *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & verdict(rules, c)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that quality() would keep, each judged for itself; null and empty texts go,
    and an empty table gives an empty result."""
    prefix = "_m_"
    while any(x.startswith(prefix) for x in docs.columns):
        prefix += "_"
    rows, c = measured(docs, text, prefix), _columns(prefix)
    failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    return rows.where(~failed & verdict(rules, c)).select(*[F.col(f"`{x}`") for x in docs.columns])
