"""JSON numbers kept as they are written.

The engine's JSON types hold a number as a long, a decimal or a double, so `1.10`, `1e400` and
long fractions come out as others. Before such a document is parsed, the numbers in question
are made text, marked with a tag that cannot occur in the document; after rendering, the mark
is taken off again.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A number in an object follows a key or an element; it needs the tag with a fraction, an
# exponent, a minus before zero, or more digits than every number type holds.
_ALTERED = r'(?:"\s*:|[\[,])\s*(?:-?[0-9]+[.eE]|-?[0-9]{17}|-0)'

# What stands before the next such number: anything but strings and numbers, strings, and
# short integers. Every loop is possessive, so the matcher neither backtracks nor recurses.
_BEFORE = r'(?:[^"0-9-]++|"(?:[^"\\]++|\\.)*+"|-?[1-9][0-9]{0,15}+(?![0-9.eE+-]))*+'
# Only a whole, well-formed number: any other stays as it is, for the parser to refuse.
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+(?![0-9.eE+-])"


def number_tag(body: Column) -> Column:
    """The tag of a document; NULL where no number needs one.

    No document holds the start of its own digest, so no text in it is taken for a number.
    """
    return F.when(body.rlike(_ALTERED), F.substring(F.sha2(body, 256), 1, 16))


def tagged(body: Column, tag: Column) -> Column:
    """The document with its numbers as tagged text, the document itself where `tag` is NULL.

    Text may stand where a number may, and as a key besides; check the document as it came
    for keys.
    """
    mark = F.concat(F.lit('$1"'), tag, F.lit("$2"), tag, F.lit('"'))
    return F.coalesce(F.regexp_replace(body, F.lit(rf"\G({_BEFORE})({_NUMBER})"), mark), body)


def untagged(rendered: Column, tag: Column) -> Column:
    """JSON text with the tagged texts as numbers again."""
    opened = F.replace(rendered, F.concat(F.lit('"'), tag), F.lit(""))
    return F.when(tag.isNull(), rendered).otherwise(F.replace(opened, F.concat(tag, F.lit('"')), F.lit("")))


def is_tagged(value: Column, tag: Column) -> Column:
    """True for the text of a tagged number."""
    return F.coalesce(F.startswith(value, tag), F.lit(False))
