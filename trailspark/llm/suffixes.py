"""Exact removal of repeated byte strings by sparse suffix arrays, sorted deep-shallow.

A string of `LENGTH` bytes is repeated if it also starts anywhere else. Not every suffix needs
sorting: each string holds an anchor, the position of its smallest hash of `GRAM` bytes, and
equal strings hold it at the same offset. So strings are gathered by anchor:

1. Each task finds the anchors of its texts and, for each, the run of strings that it serves.
   An anchor whose gram occurs once cannot serve a repeated string and is dropped.
2. The bytes that a run of strings spans are its context. Contexts that occur twice are
   repeated as a whole; the count combines before the shuffle.
3. Distinct contexts of one gram are sorted as suffixes from the anchor on (to the right) and
   as reversed prefixes (to the left): multikey quicksort to a shallow depth, blind tries for
   the groups that still agree there. Joining the sorted prefixes from the longest common one
   down, and looking up neighbours among the sorted suffixes, gives for each context the
   strings it shares with any other.
4. A gram with more than `GROUP` distinct contexts is not gathered in a task: its strings
   become rows that are counted, which again combines before the shuffle.
5. Repeated strings become spans per text, and the rest of the bytes is kept.

Defined cases: a null text is empty; texts shorter than `LENGTH` bytes keep everything; texts
of any length are taken whole, in overlapping blocks; rows equal in id and text remove each
other's strings like any two texts; ids may be null or repeat (rows are told apart by a hash
of id and text); an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StructField, StructType,
)

from trailspark.llm.batches import importable, map_rows
from trailspark.llm.tables import saved, whole_text

LENGTH = 200
GRAM = 64
#: Bytes hashed at a time.
BLOCK = 1 << 21
#: Most distinct contexts of one gram that a task sorts.
GROUP = 2000
#: Multikey quicksort goes this many bytes deep, eight at a time; blind tries go on.
SHALLOW = 48
_LOW = np.uint64((1 << 24) - 1)


# Sorting


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix; the first `start` bytes are known to agree."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Sorts strings that agree for long: nodes hold a depth and branch on the byte there."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings = strings
        self.depth = depth
        self.root: list | None = None

    def insert(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        path, node = [], self.root
        while isinstance(node, tuple):  # blindly: only the branching bytes are looked at
            path.append(node)
            depth, children = node
            branch = s[depth] if depth < len(s) else -1
            node = children.get(branch) or next(iter(children.values()))
        other = self.strings[node[0]]
        same = common_prefix(s, other, self.depth)
        if same == len(s) == len(other):
            node.append(k)
            return
        above = None
        node = self.root
        while isinstance(node, tuple) and node[0] < same:
            above = node
            node = node[1][s[node[0]]]
        mine = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][mine] = [k]
            return
        theirs = other[same] if same < len(other) else -1
        split = (same, {theirs: node, mine: [k]})
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [child for _, child in sorted(node[1].items(), key=lambda x: -x[0])]
            else:
                out += node
        return out


def deep_shallow_sort(strings: list[bytes], depth: int = 0) -> list[int]:
    """Order of strings that agree in the first `depth` bytes."""
    shallow = depth + SHALLOW
    out: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        group, at = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if at >= shallow:
            trie = BlindTrie(strings, at)
            for k in group:
                trie.insert(k)
            out += trie.order()
            continue
        pivot = strings[group[len(group) // 2]][at : at + 8]
        less, equal, more = [], [], []
        for k in group:
            key = strings[k][at : at + 8]
            (equal if key == pivot else less if key < pivot else more).append(k)
        stack.append((more, at))
        if len(pivot) < 8:  # the strings end here, so they are equal
            stack.append((equal, shallow))
        else:
            stack.append((equal, at + 8))
        stack.append((less, at))
    return out


def shared_strings(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of starts of its strings that another context has too.

    A context is the reversed bytes before its anchor and the bytes from it on; starts count
    from the context's first byte, both ends included.
    """
    n = len(lefts)
    order = deep_shallow_sort(rights)
    rank = [0] * n
    for r, k in enumerate(order):
        rank[k] = r
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def meet(x: int, y: int, left: int) -> None:
        right = common_prefix(rights[x], rights[y])
        if left + right >= length:
            for k in (x, y):
                before = len(lefts[k])
                found[k].append((before - left, before + right - length))

    by_left = deep_shallow_sort(lefts)
    seams = [(common_prefix(lefts[a], lefts[b]), k) for k, (a, b) in enumerate(zip(by_left, by_left[1:]))]
    sets: list[list[int]] = [[rank[k]] for k in by_left]
    owner = list(range(n))

    def find(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for left, k in sorted(seams, key=lambda s: -s[0]):
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for r in small:
            at = bisect_left(large, r)
            if at < len(large):
                meet(order[r], order[large[at]], left)
            if at:
                meet(order[r], order[large[at - 1]], left)
            large.insert(at, r)
        owner[b] = a
        sets[b] = []
    return found


# Anchors


def anchors(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(position, first start, last start, gram hash) of the anchors of texts joined in `data`.

    `ends` are the ends of the texts. Starts whose string would leave its text are left out.
    """
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    hashes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    factor, span = 0x9E3779B97F4A7C15, 1
    while span < gram:
        hashes = hashes[:-span] * np.uint64(factor) + hashes[span:]
        factor, span = factor * factor % (1 << 64), span * 2
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    least = (mixed & ~_LOW) | np.arange(len(mixed), dtype=np.uint64)
    window, span = length - gram + 1, 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[: span - window], least[window - span :])
    at = (least & _LOW).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[np.minimum(text, len(ends) - 1)]
    starts, at, text = starts[inside], at[inside], text[inside]
    if not len(starts):
        return starts, starts, starts, np.zeros(0, np.uint64)
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(text) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(starts)])) - 1
    return at[first], starts[first], starts[last], hashes[at[first]]


def _blocks(keys: list[int], texts: list[bytes]) -> Iterator[tuple[list, list, bytes]]:
    """(key of each text, its offset, joined bytes); long texts come in overlapping blocks."""
    names, offsets, parts, size = [], [], [], 0
    for key, text in zip(keys, texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            part = text[start : start + BLOCK + LENGTH - 1]
            names.append(key)
            offsets.append(start)
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield names, offsets, parts
                names, offsets, parts, size = [], [], [], 0
    if parts:
        yield names, offsets, parts


_ANCHOR = StructType(
    [StructField(n, t, False) for n, t in (
        ("key", LongType()), ("at", IntegerType()), ("low", IntegerType()), ("high", IntegerType()),
        ("gram", LongType()), ("context", LongType()))]
)


def _find_anchors(texts: DataFrame) -> DataFrame:
    """Rows of `_ANCHOR` for (key, text)."""
    importable(texts.sparkSession)
    arrow = to_arrow_schema(_ANCHOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = batch.column(1).cast(pa.binary()).to_pylist()
            for names, offsets, parts in _blocks(batch.column(0).to_pylist(), rows):
                data = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                at, low, high, gram = anchors(data, ends)
                if not len(at):
                    continue
                text = np.searchsorted(ends, low, side="right")
                shift = np.array(offsets)[text] - np.concatenate(([0], ends[:-1]))[text]
                spans = zip(low.tolist(), (high + LENGTH).tolist())
                context = np.fromiter((digest(data[a:b]) for a, b in spans), np.uint64, len(at))
                columns = (np.array(names, np.int64)[text], at + shift, low + shift, high + shift, gram.view(np.int64), context.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return texts.select("key", "text").mapInArrow(run, _ANCHOR)


# The operator


def _packed(texts: DataFrame) -> DataFrame:
    """(key, packed text), which shuffles at a third of its size."""
    added = StructType([StructField("packed", BinaryType(), False)])

    def make():
        pack = zstandard.ZstdCompressor(level=3).compress
        return lambda values: [(pack(v.encode()),) for v in values]

    return map_rows(texts, ["key"], ["text"], added, make)


_CONTEXT = StructType(
    [StructField(n, t, False) for n, t in (
        ("gram", LongType()), ("low", IntegerType()), ("before", BinaryType()), ("after", BinaryType()))]
)


def _cut_contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of contexts (key, at, low, high, gram, n, many), by way of their texts."""
    per_text = wanted.groupBy("key").agg(
        F.collect_list(F.struct("gram", "at", "low", "high", "n", "many")).alias("contexts")
    )
    added = StructType([StructField("cut", ArrayType(StructType(
        [*_CONTEXT.fields, StructField("n", LongType(), False), StructField("many", LongType(), False)])), False)])

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def cut(packed, contexts):
            data = unpack(packed)
            return [
                {
                    "gram": c["gram"], "low": c["low"], "before": data[c["low"] : c["at"]][::-1],
                    "after": data[c["at"] : c["high"] + LENGTH], "n": c["n"], "many": c["many"],
                }
                for c in contexts
            ]

        return lambda packed, contexts: [(cut(*x),) for x in zip(packed, contexts)]

    joined = _packed(texts).join(per_text, "key")
    return map_rows(joined, ["key"], ["packed", "contexts"], added, make).select("key", F.inline("cut"))


_SPAN = StructType([StructField("key", LongType(), False), StructField("start", LongType(), False), StructField("end", LongType(), False)])


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges, sorted, without overlaps or seams."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """Spans of the strings that contexts of one gram share; rows of a gram come together."""
    importable(contexts.sparkSession)
    arrow = to_arrow_schema(_SPAN)

    def solve(group: list[dict]) -> list[tuple[int, int, int]]:
        shared = shared_strings([g["before"] for g in group], [g["after"] for g in group], LENGTH)
        return [
            (g["key"], g["low"] + a, g["low"] + b)
            for g, ranges in zip(group, shared) if g["n"] == 1
            for a, b in _merged([(a, b + LENGTH) for a, b in ranges])
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            spans = []
            for row in batch.to_pylist():
                if group and group[0]["gram"] != row["gram"]:
                    spans += solve(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_pylist([dict(zip(_SPAN.names, s)) for s in spans], schema=arrow)
        if group:
            yield pa.RecordBatch.from_pylist([dict(zip(_SPAN.names, s)) for s in solve(group)], schema=arrow)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, _SPAN)


def _counted_spans(contexts: DataFrame) -> DataFrame:
    """The same by counting each string; for grams with too many contexts to sort in a task."""
    added = StructType([StructField("strings", ArrayType(LongType(), False), False)])

    def hashes(before, after):
        data = before[::-1] + after
        return [xxhash.xxh3_64_intdigest(data[k : k + LENGTH]) - (1 << 63) for k in range(len(data) - LENGTH + 1)]

    def make():
        return lambda befores, afters: [(hashes(*x),) for x in zip(befores, afters)]

    rows = map_rows(contexts, ["gram", "key", "low", "n"], ["before", "after"], added, make)
    rows = rows.select("gram", "key", "low", "n", F.posexplode("strings").alias("at", "string"))
    several = rows.groupBy("gram", "string").count().filter("count > 1").select("gram", "string")
    start = (F.col("low") + F.col("at")).cast("long")
    repeated = rows.filter("n = 1").join(several, ["gram", "string"])
    return repeated.select("key", start.alias("start"), (start + LENGTH).alias("end"))


def repeated_spans(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, start, end) of bytes covered by repeated strings; spans may overlap.

    `texts` has a long `key` and a string `text`, no nulls; equal keys mean equal texts.
    """
    found = _find_anchors(texts)
    several = found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    several = saved(several, "grams")  # else the join could not split a gram that holds many rows
    found = saved(found.join(several, "gram"), "anchors")
    contexts = found.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "at", "low", "high")).alias("r")
    )
    contexts = saved(contexts, "contexts")
    whole = found.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"])
    whole = whole.select("key", F.col("low").cast("long").alias("start"), (F.col("high") + LENGTH).cast("long").alias("end"))
    many = contexts.groupBy("gram").agg(F.count("*").alias("many"), F.min("n").alias("least"))
    many = many.filter("many > 1 AND least = 1").select("gram", "many")
    wanted = contexts.join(many, "gram").select("r.*", "gram", "n", "many")
    cut = saved(_cut_contexts(texts, wanted), "cut")
    spans = whole.union(_sorted_spans(cut.filter(F.col("many") <= group)))
    if not cut.filter(F.col("many") > group).isEmpty():
        spans = spans.union(_counted_spans(cut.filter(F.col("many") > group)))
    return spans


def remove_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace the text by `kept` (binary) and add `spans`, the removed (start, end) in bytes."""
    key = F.xxhash64(F.col(doc_id), whole_text(text))
    docs = docs.drop("kept", "spans")
    texts = docs.select(key.alias("key"), whole_text(text).alias("text"))
    per_text = repeated_spans(texts).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    others = [c for c in docs.columns if c != text]
    rest = docs.select(F.struct(*others).alias("rest"), key.alias("key"), whole_text(text).alias("text"))
    pack = StructType([StructField("packed", BinaryType(), False)])

    def make_pack():
        compress = zstandard.ZstdCompressor(level=3).compress
        return lambda values: [(compress(v.encode()),) for v in values]

    packed = map_rows(rest, ["rest", "key"], ["text"], pack, make_pack)
    joined = packed.join(per_text, "key", "left")
    span = StructType([StructField("start", LongType(), False), StructField("end", LongType(), False)])
    added = StructType([StructField("kept", BinaryType(), False), StructField("spans", ArrayType(span, False), False)])

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def cut(packed, ranges):
            data = unpack(packed)
            spans = _merged([(r["start"], r["end"]) for r in ranges or ()])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            return kept, [{"start": a, "end": b} for a, b in spans]

        return lambda packed, ranges: [cut(*x) for x in zip(packed, ranges)]

    return map_rows(joined, ["rest"], ["packed", "ranges"], added, make).select("rest.*", "kept", "spans")
