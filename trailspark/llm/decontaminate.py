"""Benchmark decontamination by canonical templates.

The words of documents and benchmark items become templates: numbers, names (capitalised
words within a sentence) and units behind a number turn into typed placeholders, other words
are lower-cased and lose their punctuation. Windows of eight template words are hash-joined.
Matching windows on one alignment count if its slots agree: wherever the item repeats a value,
the document repeats its own value, so a question with other numbers or names is caught and a
chance match of templates is not. Windows with the item's own values count in any case, and
windows with fewer than four words that are not placeholders match only so, by the hash of
their words. A document is contaminated by the share of the item's words that its windows
cover, or by a long run of covered words. Everything is built-in functions.

Defined cases: a null text has no words; items shorter than a window are too short to be told
from prose and match nothing; equal items are all reported; repeated documents are judged alike; texts of any
length are searched whole; empty documents give no rows and an empty benchmark leaves every
document clean; rows with a null document id are returned as clean, since nothing can name
them; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.once import compute_once
from trailspark.llm.tables import saved, whole_text, words_of
from trailspark.llm.windows import add_window_hashes

WINDOW = 8
#: Words of a window that must not be placeholders.
LITERALS = 4
#: Share of an item's words that makes a document contaminated, or this many in a row: of the
#: item's own words, or of its template.
SHARE = 0.5
QUOTE = 13
RUN = 31
#: Largest side that is sent to every task: 2^20 rows of a few longs are some tens of megabytes.
BROADCAST_ROWS = 1 << 20

#: Units of measure, as they stand behind a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs hours days weeks years "
    "percent % usd eur dollars euros cents mph kmh hz khz mhz ghz w kw kwh v a c f k j kj cal kcal"
).split()
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})[\p{L}\p{M}]*"
_NUMBER = r"\p{N}(?:[\p{N}.,:/]*\p{N})?"
_UNIT = "(?<=§n) (?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
_PUNCTUATION = r"[^\p{L}\p{M}\p{N}§ ]+"
_OUTER = r"(?<![\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N} ]+|[^\p{L}\p{M}\p{N} ]+(?![\p{L}\p{M}\p{N}])"


def _add_template(df: DataFrame) -> DataFrame:
    """One template word for each of `_words`; the section sign marks placeholders."""
    df = df.withColumn("_plain", F.replace(F.array_join("_words", " "), F.lit("§"), F.lit("")))
    df = df.withColumn("_named", F.lower(F.regexp_replace("_plain", _NAME, "§p")))
    numbered = F.regexp_replace(F.regexp_replace("_named", _NUMBER, "§n"), _UNIT, " §u")
    marked = F.when(F.col("_named").rlike(r"\p{N}"), numbered).otherwise(F.col("_named"))
    words = F.split(F.regexp_replace(marked, _PUNCTUATION, ""), " ")
    return df.withColumn("_template", F.when(F.size("_words") > 0, words)).drop("_plain", "_named")


def templates(df: DataFrame, text: str) -> DataFrame:
    """Add `_words`, `_template` and the hashes `_windows` of the template's windows."""
    df = df.withColumn("_words", words_of(whole_text(text)))
    df = _add_template(df)
    df = add_window_hashes(df, "_template", "_hashes", WINDOW)
    # a generator behind this would otherwise evaluate all of it again in a filter
    return compute_once(df, _windows=F.col("_hashes")).drop("_hashes")


def _own_hashes(df: DataFrame) -> DataFrame:
    """Add `_own`, the hashes of the windows of `_words`, lower-cased and without outer punctuation."""
    bare = F.regexp_replace(F.lower(F.replace(F.array_join("_words", " "), F.lit("§"), F.lit(""))), _OUTER, "")
    df = df.withColumn("_bare", F.when(F.size("_words") > 0, F.split(bare, " ")))
    df = add_window_hashes(df, "_bare", "_own_hashes", WINDOW)
    return compute_once(df, _own=F.col("_own_hashes")).drop("_bare", "_own_hashes")


def item_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(h, item_id, at, slots, values, n_words, own) of the windows of the items.

    Windows of too few words that are not placeholders are `own`: `h` is the hash of their words.
    """
    df = templates(benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("_item")), "_item")
    df = _own_hashes(df.filter(F.size("_windows") > 0))
    hashes = F.arrays_zip(F.col("_windows").alias("t"), F.col("_own").alias("o"))
    df = df.select("item_id", "_words", "_template", F.posexplode(hashes).alias("at", "_h"))
    template = F.slice("_template", F.col("at") + 1, F.lit(WINDOW))
    slots = F.filter(
        F.transform(template, lambda t, k: F.when(t.startswith("§"), k)), lambda k: k.isNotNull()
    )
    df = df.withColumn("slots", slots)
    df = df.withColumn("values", _values(F.col("_words"), F.col("at"), F.col("slots")))
    own = F.size("slots") > WINDOW - LITERALS
    none = F.array()
    return df.select(
        F.when(own, F.col("_h.o")).otherwise(F.col("_h.t")).alias("h"), "item_id", "at",
        F.when(own, none.cast("array<int>")).otherwise(F.col("slots")).alias("slots"),
        F.when(own, none.cast("array<string>")).otherwise(F.col("values")).alias("values"),
        F.size("_words").alias("n_words"), own.alias("own"),
    )


def _values(words: Column, at: Column, slots: Column) -> Column:
    return F.transform(slots, lambda k: F.lower(F.get(words, at + k)))


def _covered(ats: Column) -> Column:
    """Words covered by the windows at these sorted positions."""
    gaps = F.zip_with(
        F.slice(ats, F.lit(1), F.size(ats) - 1), F.slice(ats, F.lit(2), F.size(ats) - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    return F.when(F.size(ats) > 0, F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)).otherwise(0)


def _longest(ats: Column) -> Column:
    """Words in the longest run that windows at these sorted positions cover without a gap."""
    start = F.struct(F.lit(0).alias("first"), F.lit(-2 * WINDOW).alias("last"), F.lit(0).alias("most"))

    def step(state, at):
        first = F.when(at - state["last"] <= WINDOW, state["first"]).otherwise(at)
        return F.struct(first.alias("first"), at.alias("last"), F.greatest(state["most"], at - first + WINDOW).alias("most"))

    return F.aggregate(ats, start, step, lambda state: state["most"])


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Sent to every task if it is small; else Spark joins by shuffling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc id, item_id, n_matched, n_words, kind) of items found in documents.

    `n_matched` of the `n_words` words of the item are covered by matching windows. `kind` is `verbatim` or `reparameterised`.
    """
    items = saved(item_windows(benchmark, item_id, item_text), "items")
    n_own, n_items = items.agg(F.count_if("own"), F.count("*")).first()
    slim = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    columns = ["_id", "_at", "item_id", "at", "slots", "values", "n_words"]
    windows = templates(slim, "_text").select("_id", F.posexplode("_windows").alias("_at", "h"))
    found = windows.join(_sized(items.filter("NOT own"), n_items - n_own), "h").select(*columns)
    if n_own:
        words = _own_hashes(slim.withColumn("_words", words_of(whole_text("_text"))))
        words = words.select("_id", F.posexplode("_own").alias("_at", "h"))
        found = found.union(words.join(_sized(items.filter("own"), n_own), "h").select(*columns))
    found = saved(found, "found")

    slotted = found.filter(F.size("slots") > 0)
    named = slotted.select("_id").distinct()
    sources = slim.join(_sized(named, named.count()), "_id", "left_semi").distinct()
    sources = sources.withColumn("_words", words_of(whole_text("_text"))).select("_id", "_words")
    keys = ["_id", "item_id", "shift"]
    shift = (F.col("_at") - F.col("at")).alias("shift")
    own = _values(F.col("_words"), F.col("_at"), F.col("slots"))
    slotted = saved(slotted.join(sources, "_id").select("_id", "item_id", shift, "at", "values", own.alias("own")), "slotted")
    pairs = slotted.select(*keys, F.explode(F.arrays_zip("values", "own")).alias("p"))
    pairs = pairs.select(*keys, F.col("p.values").alias("theirs"), F.col("p.own").alias("own"))
    per_value = pairs.groupBy(*keys, "theirs").agg(F.min("own").alias("a"), F.max("own").alias("b"))
    slots = per_value.groupBy(*keys).agg(
        F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("consistent"),
        F.bool_or(~F.col("theirs").eqNullSafe(F.col("a"))).alias("changed"),
    )
    same = slotted.groupBy(*keys, "at").agg(F.bool_or(F.col("values").eqNullSafe(F.col("own"))).alias("same"))
    runs = found.select("_id", "item_id", shift, "at", "n_words").distinct()
    runs = runs.join(same, [*keys, "at"], "left").join(slots, keys, "left")
    runs = runs.withColumns({
        "same": F.coalesce("same", F.lit(True)), "consistent": F.coalesce("consistent", F.lit(True)),
    }).filter("same OR consistent")
    per_run = runs.groupBy(*keys).agg(
        F.sort_array(F.collect_set("at")).alias("run"),
        F.sort_array(F.collect_set(F.when(F.col("same"), F.col("at")))).alias("quote"),
    )
    longest = per_run.groupBy("_id", "item_id").agg(
        F.max(_longest(F.col("run"))).alias("run"), F.max(_longest(F.col("quote"))).alias("quote")
    )
    hits = runs.groupBy("_id", "item_id").agg(
        _covered(F.sort_array(F.collect_set("at"))).alias("n_matched"),
        F.max("n_words").alias("n_words"),
        F.bool_or(F.col("consistent") & F.coalesce("changed", F.lit(False))).alias("changed"),
    )
    hits = hits.join(longest, ["_id", "item_id"])
    # placeholders that a changed copy cannot match do not count against its share
    usable = items.groupBy("item_id").agg(_covered(F.sort_array(F.collect_set(F.when(~F.col("own"), F.col("at"))))).alias("usable"))
    hits = hits.join(_sized(usable, n_items), "item_id")
    of = F.least("n_words", F.greatest("usable", F.lit(QUOTE)))
    hits = hits.filter((F.col("n_matched") >= of * SHARE) | (F.col("quote") >= QUOTE) | (F.col("run") >= RUN))
    kind = F.when(F.col("changed"), "reparameterised").otherwise("verbatim")
    return hits.select(
        F.col("_id").alias(doc_id), "item_id", F.col("n_matched").cast("long"),
        F.col("n_words").cast("long"), kind.alias("kind"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Add `contaminated`, `item_ids` (sorted) and `kinds`; replaces columns of these names."""
    docs = docs.drop("contaminated", "item_ids", "kinds")
    hits = saved(benchmark_hits(docs, benchmark, doc_id, text, item_id, item_text), "hits")
    verdicts = hits.groupBy(F.col(doc_id).alias("_hit")).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sort_array(F.collect_set("kind")).alias("kinds")
    )
    verdicts = _sized(verdicts, hits.count())
    judged = docs.join(verdicts, docs[doc_id] == verdicts["_hit"], "left")
    none = F.array()
    return judged.select(
        *(docs[c] for c in docs.columns),
        F.col("_hit").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", none.cast("array<bigint>")).alias("item_ids"),
        F.coalesce("kinds", none.cast("array<string>")).alias("kinds"),
    )
