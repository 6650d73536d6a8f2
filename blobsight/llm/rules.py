"""Quality rules: a table of thresholds compiled into one projection; built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsight.llm.common import BLANKS, WORD

# The commonest function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is it that for on with as are was be this at by from or an not have "
    "der die das und zu den von mit ist im dem nicht ein eine auf sich des "
    "le la les et des en un une du que est pour dans qui par sur au "
    "el los las y de se con por su para al lo como a"
).split()

SYMBOLS = "#*$%&|<>"

#: name, measure, operator, bound: a document is kept if every line holds. Measures are columns of ``measures``.
RULES = (
    ("enough words", "n_words", ">=", 50),
    ("not too many words", "n_words", "<=", 10_000_000),
    ("word length from", "mean_word", ">=", 2.0),
    ("word length to", "mean_word", "<=", 14.0),
    ("few symbols", "symbol_ratio", "<=", 0.2),
    ("some stop words", "stop_ratio", ">=", 0.02),
    ("few repeated lines", "dup_line_ratio", "<=", 0.3),
    ("few repeated windows", "repeat_ratio", "<=", 0.5),
    ("few shouted words", "shout_ratio", "<=", 0.4),
)


def srl(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def sll(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that is found twice or more; windows may overlap.

    Windows are hashed; a hash's upper bits and the window's place go into one long, so that one primitive sort brings
    windows that may be equal together and keeps their places. A place gets just the bits that the document needs. The
    few windows that look equal to another one are then compared by their words, so the count is exact.
    """

    def count(n: Column) -> Column:
        """n: number of windows."""
        bits = F.ceil(F.log2(n + 1.0)).cast("int")
        hashes = F.transform(F.slice(words, F.lit(1), n), lambda w, i: sll(srl(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits), bits).bitwiseOR(i.cast("long")))
        return let(F.sort_array(hashes), lambda s: covered(s, bits))

    def covered(s: Column, bits: Column) -> Column:
        key = lambda x: srl(x, bits)
        as_next = lambda x, i, by: F.coalesce(key(x) == key(F.get(s, i + by)), F.lit(False))
        alike = F.filter(s, lambda x, i: as_next(x, i, 1) | as_next(x, i, -1))
        place = lambda x: x.bitwiseAND(sll(F.lit(1).cast("long"), bits) - 1)
        window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))  # noqa: E731  (no word has a space)
        named = F.sort_array(F.transform(F.transform(alike, place), lambda i: F.struct(window(i.cast("int")).alias("w"), i.alias("i"))))
        same = lambda v, x, i, by: F.coalesce(x["w"] == F.get(v, i + by)["w"], F.lit(False))
        twice = let(named, lambda v: F.filter(v, lambda x, i: same(v, x, i, 1) | same(v, x, i, -1)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b))

    n = F.size(words) - 2
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(count(n))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures to ``docs``: counts and ratios of each whole text; null text has no words and all counts 0."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    inner = F.translate(body, BLANKS, "")
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    count = lambda test: lambda w: F.size(F.filter(w, test)).cast("long")
    stop = count(lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*STOP_WORDS))
    shout = count(lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), stop(w).alias("n_stop"), shout(w).alias("n_shout")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select("*", of_words.alias("_w"), of_lines.alias("_l"), F.length(inner).cast("long").alias("word_chars"), (F.length(inner) - F.length(F.translate(inner, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    names = ("n_words", "n_repeat_words", "n_stop", "n_shout")
    out = out.select("*", *[F.col(f"_w.{c}").alias(c) for c in names], *[F.col(f"_l.{c}").alias(c) for c in ("n_lines", "n_dup_lines")]).drop("_w", "_l")
    return out.withColumns({
        "mean_word": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop", "n_words"),
        "shout_ratio": ratio("n_shout", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    })


def verdict(rules=RULES) -> Column:
    """The table as one boolean column over the measures."""
    tests = {">=": lambda c, b: c >= b, "<=": lambda c, b: c <= b}
    return reduce(lambda a, b: a & b, [tests[op](F.col(m), F.lit(bound)) for _, m, op, bound in rules], F.lit(True))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratios) for every row.

    base_failed: under 50 words, or over half the words in repeated windows. kept: not base_failed, and every rule
    holds. Null, empty and blank texts have no words, counts of 0, and fail. Repeated rows, and rows of one doc_id or none, are
    judged each on its own; texts of any length are judged whole, by built-in functions on one row. An empty table gives an
    empty one. Columns of ``docs`` other than doc_id and text are left out, so their names can't clash.
    """
    found = measures(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_word", "symbol_ratio", "stop_ratio", "shout_ratio", "dup_line_ratio")
