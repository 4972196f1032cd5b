"""Quality rules: a threshold table compiled into one projection.

Each rule bounds one measure of a text. `quality_rules` computes the measures with built-in
functions, compiles the table into one boolean column per rule and keeps the documents that
pass all. Nothing is shuffled and no user function runs, so the plan is a scan with
projections.

Defined cases: a null text has no words, so it fails `words`; measures per word or line are
null without words or lines, and a null measure passes its rule; very long texts are counted
whole (the cost is n log n in the words of one text); equal rows are judged alike and all
returned; an empty table gives no rows; other columns are passed through, and the columns
added replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.once import compute_once
from trailspark.llm.tables import BLANKS, whole_text, words_of
from trailspark.llm.windows import add_window_hashes

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is for it on as with was by at this from are be or an not which "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le les et un une que qui dans pour par sur est au elle avec "
    "los las el y del se por con una para como"
).split()
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`low <= measure <= high`; a missing bound is not checked. Applies from `from_words` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The base rules decide `base_failed`; the others are this method's own.
BASE_RULES = (
    Rule("words", "n_words", low=20),
    Rule("repeated_windows", "repeat_percent", high=30.0),
)
METHOD_RULES = (
    Rule("word_length", "mean_word_length", low=2.0, high=14.0),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("capitals", "capital_ratio", high=0.5),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.01, from_words=50),
)


def _passes(rule: Rule) -> Column:
    value = F.col(rule.measure)
    bounds = F.lit(True)
    if rule.low is not None:
        bounds = bounds & (value >= rule.low)
    if rule.high is not None:
        bounds = bounds & (value <= rule.high)
    return F.coalesce(bounds, F.lit(True)) | (F.col("n_words") < rule.from_words)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add `n_repeat_words` for the array `_words`: words inside a window that occurs twice.

    Only a text in which a window repeats sorts its windows; equal neighbours are the repeats,
    and the gaps between their positions give the words they cover.
    """
    df = add_window_hashes(df, "_words", "_h", WINDOW)
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_h", F.when(repeats, F.sort_array(pairs)))
    df = df.withColumn(
        "_h",
        F.sort_array(
            F.transform(
                F.filter(
                    "_h",
                    lambda x, k: F.coalesce(x["h"] == F.get("_h", k - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get("_h", k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    gaps = F.zip_with(
        F.slice("_h", F.lit(1), F.size("_h") - 1),
        F.slice("_h", F.lit(2), F.size("_h") - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_h") > 0, covered), F.lit(0)).cast("long"))


def measure_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that the rules read."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RATIOS)
    df = docs.drop(*(c for c in added if c != text))
    df = df.withColumn("_text", whole_text(text))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    )
    df = _repeat_words(df)
    stops = F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))
    capitals = F.filter(
        "_words", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))
    )
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        F.size(stops).alias("_n_stops"),
        F.size(capitals).alias("_n_capitals"),
    )
    per_word = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    df = df.withColumns(
        {
            "repeat_percent": F.col("n_repeat_words") * 100 / per_word,
            "mean_word_length": F.col("word_chars") / per_word,
            "symbols_per_word": F.col("n_symbols") / per_word,
            "capital_ratio": F.col("_n_capitals") / per_word,
            "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("_n_lines"), F.lit(0)).cast("double"),
            "stop_word_ratio": F.col("_n_stops") / per_word,
        }
    )
    return df.drop("_text", "_words", "_lines", "_h", "_n_lines", "_n_stops", "_n_capitals")


RATIOS = (
    "repeat_percent", "mean_word_length", "symbols_per_word", "capital_ratio", "dup_line_ratio",
    "stop_word_ratio",
)


def quality_rules(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = METHOD_RULES
) -> DataFrame:
    """Add the measures, `base_failed`, the names of the `failed_rules` and `kept`."""
    df = measure_text(docs.drop("base_failed", "failed_rules", "kept"), text)
    failed = F.array_compact(
        F.array(*(F.when(~_passes(rule), F.lit(rule.name)) for rule in (*BASE_RULES, *rules)))
    )
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | ~_passes(rule)
    df = compute_once(df, base_failed=base, failed_rules=failed)
    return df.withColumn("kept", F.size("failed_rules") == 0)
