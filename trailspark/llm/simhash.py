"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

To find all pairs of 64-bit fingerprints that differ in at most r bits, every bit position is
given a nonzero vector of r + 1 bits, and every nonzero vector v of r + 1 bits makes a table:
its mask keeps the positions whose vector has an odd product with v. The vectors of r differing
positions never span the whole space, so some v is orthogonal to all of them, and the pair
falls into one bucket of that table: no pair is missed.

Equal fingerprints are one row. Buckets up to a bound are compared within a task and give a
spanning forest, never all pairs. A larger bucket is dealt to tables over the positions its
mask left out, by the same construction; after three levels at most 2^8 fingerprints can share
a bucket, so the bound is always met and nothing is dropped.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked
like any other; texts shorter than a shingle are one shingle; texts of any length are taken
whole; equal rows are all returned; rows with a null id keep their fingerprint and take the
component of their fingerprint's smallest id; an empty table gives no rows; other columns are
passed through.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from trailspark.llm.batches import map_rows
from trailspark.llm.components import components
from trailspark.llm.tables import saved

SEED = 42
BITS = 64
#: Largest bucket compared within a task.
BUCKET = 1024
#: Largest side that is sent to every task: 2^20 ids are eight megabytes.
BROADCAST_ROWS = 1 << 20


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of every run of `words` words, A-Z lower-cased, joined by single spaces."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())
    return [digest(joined[a:b], SEED) for a, b in spans]


def fingerprint(text: str | None, words: int) -> int:
    """As a signed 64-bit integer; a bit is set if it is set in over half of the hashes."""
    hashes = shingle_hashes(text, words)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65536):
        part = np.array(hashes[start : start + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """Add `simhash`, a long."""

    def make():
        return lambda texts: [(fingerprint(t, words),) for t in texts]

    added = StructType([StructField("simhash", LongType(), False)])
    return map_rows(docs, [c for c in docs.columns if c != "simhash"], [text], added, make)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """One mask per table over these bit positions."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        odd = (p for k, p in enumerate(positions) if ((k % vectors + 1) & v).bit_count() % 2)
        masks.append(sum(1 << p for p in odd))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deeper(mask: int, radius: int) -> list[int]:
    left_out = [p for p in range(BITS) if not mask >> p & 1]
    return [mask | m for m in covering_masks(left_out, radius)]


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what chains of at most `radius` differing bits connect."""
    left = np.array(values, np.int64).view(np.uint64)
    links = []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            node, frontier = frontier[0], frontier[1:]
            near = np.bitwise_count(left ^ node) <= radius
            found = left[near]
            links += [(int(np.int64(node)), int(np.int64(x))) for x in found.view(np.int64)] if len(found) else []
            frontier, left = np.concatenate((frontier, found)), left[~near]
    return links


def near_links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct values of `simhash` that connect all pairs within `radius`."""
    spark = prints.sparkSession
    masks = covering_masks(list(range(BITS)), radius)
    rows = prints.select(
        F.col("simhash").alias("fp"), F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")
    )
    found = []
    for level in range(3):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(
            F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        sizes = saved(sizes.filter("n > 1"), f"buckets{level}")
        found.append(sizes.filter("n = 2").select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        members = rows.join(sizes.filter("n > 2").select("mask", "key", "n"), ["mask", "key"])
        groups = members.filter(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(_linked(groups, radius))
        if sizes.filter(F.col("n") > bucket).isEmpty():
            break
        deeper = [(_signed(m), _signed(d)) for m in masks for d in _deeper(m, radius)]
        masks = [d % (1 << 64) for _, d in deeper]
        # 15 masks a level: 225 rows, then 3,375, whatever the data
        split = F.broadcast(spark.createDataFrame(deeper, "mask long, finer long"))
        members = members.filter(F.col("n") > bucket).join(split, "mask").select("fp", F.col("finer").alias("mask"))
        rows = saved(members, f"members{level}")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _linked(groups: DataFrame, radius: int) -> DataFrame:
    link = StructType([StructField("a", LongType(), False), StructField("b", LongType(), False)])
    added = StructType([StructField("links", ArrayType(link, False), False)])

    def make():
        return lambda lists: [([{"a": a, "b": b} for a, b in _forest(x, radius)],) for x in lists]

    return map_rows(groups, [], ["fps"], added, make).select(F.inline("links"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """Add `simhash` and `component_id`, the smallest id reachable over links, itself included."""
    docs = docs.drop("component_id")
    slim = saved(add_fingerprints(docs.select(doc_id, text), text, words).select(doc_id, "simhash"), "simhash")
    prints = saved(slim.groupBy("simhash").agg(F.min(doc_id).alias("first_id")), "prints")
    roots = components(near_links(prints, radius), "a", "b")
    classes = prints.join(roots, prints["simhash"] == roots["node"], "left").select(
        "simhash", "first_id", F.coalesce("root", "simhash").alias("root")
    )
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(smallest, "root").select("simhash", "component_id")
    return slim.join(classes, "simhash").select(doc_id, "simhash", "component_id")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """The document with the smallest id of each component; one row where an id repeats.

    Rows without an id cannot be told apart and are all kept.
    """
    found = saved(near_duplicates(docs, doc_id, text, words, radius), "components")
    kept = found.filter(F.col(doc_id) == F.col("component_id")).groupBy(doc_id).count()
    kept = saved(kept, "kept")
    rows, most = kept.agg(F.count("*"), F.max("count")).first()
    chosen = kept.select(doc_id)
    chosen = F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen
    named = docs.join(chosen, doc_id, "left_semi").select(*docs.columns)
    if (most or 0) > 1:
        named = named.dropDuplicates([doc_id])
    return named.union(docs.filter(F.col(doc_id).isNull()))
