"""Quality rules: a table of thresholds compiled into one projection of built-in column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "be", "this", "by", "from", "at", "or", "an", "a",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "ein", "eine", "nicht", "auf", "für", "auch", "sich", "dem", "des", "zu",
    "le", "la", "les", "et", "est", "une", "un", "du", "que", "qui", "dans", "pour", "pas", "sur", "par", "au", "ne", "ce", "elle", "il",
    "el", "los", "las", "y", "es", "una", "por", "con", "para", "se", "del", "su", "no", "lo", "de", "en", "como", "más",
]


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie in [low, high]; denominator None: the count itself; a zero denominator counts as 1."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        top = F.col(self.numerator).cast("double")
        below = F.greatest(F.col(self.denominator), F.lit(1)).cast("double") if self.denominator else F.lit(1.0)
        ok = F.lit(True)
        # compared without a division, so that a ratio on a bound is exact
        if self.low is not None:
            ok = ok & (top >= F.lit(self.low) * below)
        if self.high is not None:
            ok = ok & (top <= F.lit(self.high) * below)
        return ok


# what every rule set rejects
BASE = [Rule("enough_words", "n_words", None, low=50), Rule("repeated_words", "n_repeat_words", "n_words", high=0.5)]
RULES = [
    Rule("not_too_long", "n_words", None, high=100_000),
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=12),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", None, low=2),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.6),
]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words (long).

    Words are runs of characters other than space and the five ASCII controls
    from tab to carriage return; lines end at a line feed and count if they hold
    a word. A null text has none. Each step is one projection over the row's own
    arrays; sorting keeps the work at n log n for a long text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: _without(x, SPACE_CHARS) != "")
    step = docs.withColumns({"_words": words, "_lines": lines, "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"),
                             "word_chars": F.length(_without(t, SPACE_CHARS)).cast("long")})
    w, n = F.col("_words"), F.size("_words")
    pair = F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    triple = F.zip_with(pair, F.slice(w, 3, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    step = step.withColumns({
        "n_words": n.cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        # past the last window one of the three words is missing and the sum is null
        "_windows": F.array_sort(F.slice(F.transform(triple, lambda x, i: F.struct(x.alias("w"), i.alias("p"))), 1, F.greatest(n - 2, F.lit(0))))}).drop("_words", "_lines")
    s, m = F.col("_windows"), F.size("_windows")
    same = F.zip_with(s, F.slice(s, 2, F.greatest(m, F.lit(1))), lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False)))
    step = step.withColumn("_same", same)
    before = F.concat(F.array(F.lit(False)), F.col("_same"))
    repeated = F.zip_with(s, F.zip_with(F.col("_same"), before, lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda x, r: F.when(r, x["p"]))
    step = step.withColumn("_at", F.array_sort(F.filter(repeated, lambda p: p.isNotNull())))
    gaps = F.zip_with(F.col("_at"), F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return step.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)).drop("_windows", "_same", "_at")


def judge(docs: DataFrame, *, text: str = "text", base: list[Rule] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """The measured documents with base_failed, failed (names of the broken rules) and kept. All rows stay.

    A null text has no words, so it fails the base. The new names, and those of
    the steps (_words, _lines, _windows, _same, _at), replace columns of the same name.
    """
    base, rules = BASE if base is None else base, RULES if rules is None else rules
    bad = F.lit(False)
    for rule in base:
        bad = bad | ~rule.passes()
    broken = F.array_compact(F.array(*[F.when(~rule.passes(), F.lit(rule.name)) for rule in rules])) if rules else F.array().cast("array<string>")
    out = measure(docs, text).withColumns({"base_failed": bad, "failed": broken})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
