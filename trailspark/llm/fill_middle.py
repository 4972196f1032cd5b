"""Fill-in-middle texts: prefix, middle and suffix by one match of a counted pattern.

A text is cut into units, each a run of letters or one other character. `regexp_count` gives
their number n; two hash values of the document choose two cut points in 0..n, and a pattern
made for the row, `unit{a}` and `unit{b-a}` with possessive counts, captures the three parts in
one match. The match is rewritten by the same call that finds it, so a document is scanned once
to count and once to cut. Possessive counts are loops: the matcher neither backtracks nor
recurses, whatever the length of the text. Everything is a projection of built-in functions.

Defined cases: a null text counts as empty; an empty text and a text that holds a marker stay
plain; a null id is hashed as the empty id; equal rows are cut alike and all returned; an empty
table gives no rows; other columns are passed through, and the columns added replace columns of
the same name. Very long texts are cut whole; a text has fewer than 2^31 units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.once import compute_once
from trailspark.llm.tables import whole_text

# The unit of a cut, the markers, the shares of the forms.
UNIT = "[A-Za-z]+|[^A-Za-z]"
_POSSESSIVE_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FillMiddle:
    """How texts are cut. Of 100 documents about `rate` are cut, `spm_rate` of these suffix first.

    No marker may begin with the end of a marker or hold another one, so that in a finished text
    a marker is found only where it was put.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    spm_rate: int = 20
    seed: str = "1:"

    def __post_init__(self):
        markers = self.markers
        if len(set(markers)) < 3 or not all(markers):
            raise ValueError("three different markers, none empty")
        for a, b in product(markers, markers):
            if a != b and a in b or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"the markers {a} and {b} can be mistaken for each other in a text")

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _hash_words(seed: str, doc_id: Column) -> list[Column]:
    """The first four groups of 8 hexadecimal digits of the digest, as unsigned numbers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _literal(text: str) -> str:
    """A replacement text with nothing special in it."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _pattern(text: str) -> str:
    """A pattern that matches just the text."""
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def _counted(n: Column) -> Column:
    return F.concat(F.lit(_POSSESSIVE_UNIT + "{"), n.cast("string"), F.lit("}+"))


def fill_middle(docs: DataFrame, how: FillMiddle = FillMiddle(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `n`, `form`, `output`, `prefix_chars` and `middle_chars` (null for a plain text)."""
    given = docs.drop(*(c for c in ("n", "form", "output", "prefix_chars", "middle_chars") if c not in (doc_id, text)))
    h1, h2, h3, h4 = _hash_words(how.seed, F.col(doc_id))
    read = given.withColumn("_text", whole_text(text))
    read = compute_once(read, n=F.regexp_count("_text", F.lit(UNIT)).cast("bigint"), _h1=h1, _h2=h2, _h3=h3, _h4=h4)
    units = F.col("n") + 1
    cut_a, cut_b = F.col("_h1") % units, F.col("_h2") % units
    marked = F.lit(False)
    for marker in how.markers:
        marked = marked | F.contains("_text", F.lit(marker))
    form = (
        F.when((F.col("_text") == "") | marked | (F.col("_h3") % 100 >= how.rate), PLAIN)
        .when(F.col("_h4") % 100 < how.spm_rate, SPM)
        .otherwise(PSM)
    )
    read = compute_once(read, form=form, _a=F.least(cut_a, cut_b), _b=F.greatest(cut_a, cut_b))
    pattern = F.concat(
        F.lit(r"\A("), _counted(F.col("_a")), F.lit(")("), _counted(F.col("_b") - F.col("_a")), F.lit(r")((?s:.*+))\z")
    )
    p, s, m = (_literal(marker) for marker in how.markers)
    order = F.when(F.col("form") == SPM, f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    output = F.when(F.col("form") == PLAIN, F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    read = compute_once(read, output=output)
    parts = cut_parts(F.col("output"), F.col("form"), how)
    read = compute_once(read, _parts=parts)
    return read.select(
        *given.columns, "n", "form", "output",
        F.length(F.col("_parts.prefix")).cast("bigint").alias("prefix_chars"),
        F.length(F.col("_parts.middle")).cast("bigint").alias("middle_chars"),
    )


def cut_parts(output: Column, form: Column, how: FillMiddle = FillMiddle()) -> Column:
    """Struct of `prefix, middle, suffix` of a finished text; null for a plain one.

    A marker stands in a text once, so the parts lie between where the markers are found.
    """
    split = F.split(output, "|".join(_pattern(marker) for marker in how.markers))
    first, second, third = (F.get(split, F.lit(k)) for k in (1, 2, 3))
    spm = form == SPM
    parts = F.struct(
        F.when(spm, second).otherwise(first).alias("prefix"),
        third.alias("middle"),
        F.when(spm, first).otherwise(second).alias("suffix"),
    )
    return F.when(form != PLAIN, parts)


def restore_text(output: Column, form: Column, how: FillMiddle = FillMiddle()) -> Column:
    """The text a finished text was made of."""
    parts = cut_parts(output, form, how)
    return F.when(form == PLAIN, output).otherwise(F.concat(parts["prefix"], parts["middle"], parts["suffix"]))
