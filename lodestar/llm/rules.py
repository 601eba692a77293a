"""Quality rules: a table of thresholds compiled into one Spark projection.

The measures are built-in functions over the words and lines of a text. Repeated
windows are looked for only in texts that have any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

# The commonest words of the languages served.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "as", "by", "are", "this", "be", "was", "at", "or", "from", "it", "an",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "est", "pour", "par", "sur", "au", "avec", "ce",
    "el", "los", "las", "y", "del", "se", "una", "con", "no", "su", "para", "es", "al", "lo", "como",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "dem", "ist", "im", "nicht", "ein", "eine", "auf", "auch", "als",
)

#: Words of scripts that the list has no words of count as common ones.
OTHER_SCRIPT = r"^[^A-Za-z]*[^\x00-\x7F][^A-Za-z]*$"

#: (name, measure, least, most): a text is kept if all measures lie within their bounds; NULL is no bound.
RULES = (
    ("word_length", "word_chars / n_words", 1.5, 15.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.3),
    ("stop_word_ratio", "n_stop_words / n_words", 0.03, None),
    ("exclamations_per_word", "n_exclamations / n_words", None, 0.3),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that stand twice or more in the text."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(sorted_: Column) -> Column:
            same = lambda e, j: F.coalesce(e["h"] == F.get(sorted_, j)["h"], F.lit(False))
            pick = F.transform(sorted_, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.array_sort(F.filter(pick, lambda i: i.isNotNull()))

        def width(at: Column) -> Column:
            gaps = F.zip_with(F.slice(at, F.lit(2), F.size(at)), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

        return let(let(placed, starts), width)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) > WINDOW, let(windows, count)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """One struct of all counts of a text; NULL counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))

    def line_counts(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    def counts(w: Column) -> Column:
        stop = F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS) | F.regexp_like(x, F.lit(OTHER_SCRIPT))))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), _repeated(w).cast("long").alias("n_repeat_words"),
            stop.cast("long").alias("n_stop_words"), F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"), let(lines, line_counts).alias("lines"),
        )

    return let(words, counts)


def verdict(rules=RULES) -> Column:
    """The table of thresholds as one condition over the measures' columns; a text without words fails."""
    kept = F.col("n_words") > 0
    for _, measure, least, most in rules:
        value = F.try_divide(*(F.col(x.strip()) for x in measure.split("/")))
        if least is not None:
            kept = kept & (value >= least)
        if most is not None:
            kept = kept & (value <= most)
    return F.coalesce(kept, F.lit(False))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words", "n_exclamations")


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (``doc_id``, ``text``).

    Words are runs outside ASCII white space. ``base_failed``: fewer than 20 words, or
    more than 30% of them in repeated windows. ``kept``: neither that nor outside
    a threshold. NULL, empty and blank texts have no words and are not kept.
    Repeated rows are each judged; other columns are ignored.
    """
    found = docs.select("doc_id", measures(F.col("text")).alias("m"))
    found = found.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in COUNTS), "m.lines.n_lines", "m.lines.n_dup_lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_by_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all their columns as they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = docs.select(row.alias("_row"), measures(F.col("text")).alias("m"))
    found = found.select("_row", *(F.col(f"m.{c}").alias(c) for c in COUNTS), "m.lines.n_lines", "m.lines.n_dup_lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.where(~failed & verdict(rules)).select("_row.*")
