"""Substring dedup on paragraphs: MinHash bands, exact Jaccard, components.

Paragraphs are lines of at least `min_words` words and, with `passages`, also pieces of the text
that do not depend on line ends: the words of a text are cut where a hash of two neighbouring
words is the least of those around it, so the same passage is cut alike wherever it stands.
Equal paragraphs (by the digest of their words) are one node. Each distinct paragraph gets a
MinHash signature of its five-word shingles, cut into bands that `tune_bands` chooses for recall;
pieces, of which passages that repeat word by word have several alike, have `PASSAGE_BANDS` of
their own. In every bucket each member is
paired with two centres (smallest and largest by a hash that differs from band to band), and
pairs are verified by exact Jaccard of the shingle sets. Where the other members of a bucket are
not all linked by that, every two of them that are not linked yet are compared within a task;
a bucket above a bound is dealt to pairs of blocks, without those whose members are all linked.
So no pair that shares a bucket stays open, and a group that its centres link costs pairs in
proportion to its members. Components of verified links are clusters, and of each cluster the
first occurrence (by document id, then text, then place) stays while all others are removed.
Pieces are removed where those next to each other make up `min_words` words.

A pair with similarity s fails to meet in any of b bands of r rows with probability
(1 - s^r)^b; the bands are chosen so that this stays below 0.1 % at the threshold. Two
paragraphs of one cluster need not meet each other: a link to a common centre is enough.

Defined cases: a null text has no paragraphs and stays null; lines below `min_words` and single
pieces below it are never removed; texts of any length are cut whole; of a passage that stands
inside different lines, up to a piece of words at each end stays; repeated documents lose their
repeated paragraphs like any other; rows with a null id are returned untouched; rows with equal
ids and equal texts are treated as one document, rows with equal ids and other texts as
documents of their own; an empty table gives no rows; other columns are passed through, and the
columns added replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from trailspark.llm.batches import importable, map_rows, release_memory, slices
from trailspark.llm.components import components
from trailspark.llm.tables import saved

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 20
MISSED = 0.001
#: Hashes in a signature, at most.
SIGNATURE = 30
#: A text is cut at words whose hash is the least of as many on each side, into pieces of at
#: least one more and about twice as many words.
CUT_REACH = 8
#: Pieces at the ends of a text may be shorter; those below this are no paragraphs.
PASSAGE_WORDS = 8
PASSAGE_BANDS = 1
#: Bytes of texts that a task signs at a time; a longer text is signed by itself.
SLICE_BYTES = 1 << 20
#: Largest side that is sent to every task: 2^20 rows of a few longs are some tens of megabytes.
BROADCAST_ROWS = 1 << 20

#: Members of a bucket compared within a task; a larger bucket is dealt to pairs of blocks.
GROUP = 512


def tune_bands(similarity: float = SIMILARITY, missed: float = MISSED, size: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands miss at most `missed` at the threshold."""
    best = (size, 1)
    for rows in range(1, size + 1):
        bands = next((b for b in range(1, size // rows + 1) if (1 - similarity**rows) ** b <= missed), None)
        if bands is not None:
            best = (bands, rows)
    return best


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of runs of five words; a shorter paragraph is one shingle."""
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64))


_U64 = np.uint64
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = _U64(0x9E3779B97F4A7C15)
_UNSTEP = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = _U64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(32))) * _SPREAD
    return x ^ (x >> _U64(29))


def _sums(values: np.ndarray, step: np.uint64, unstep: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values times the powers of an odd number, and its inverse powers.

    The hash of a run [a, b) is (sums[b] - sums[a]) * inverses[a], wherever it stands.
    """
    powers = np.full(len(values) + 1, step, np.uint64)
    inverses = np.full(len(values) + 1, unstep, np.uint64)
    powers[0] = inverses[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(inverses, out=inverses)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:-1], out=sums[1:])
    return sums, inverses


class Words:
    """The words of several texts, each by where it stands and a hash of its lower-case bytes."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.array([len(t) + 1 for t in texts])
        self.text_ends = np.cumsum(lengths) - 1
        self.text_starts = self.text_ends + 1 - lengths
        blank = _BLANK[raw]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        sums, inverses = _sums(_LOWER[raw].astype(np.uint64) + _U64(1), _STEP, _UNSTEP)
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * inverses[self.starts])
        self.text = np.searchsorted(self.text_starts, self.starts, "right") - 1
        self.newlines = np.flatnonzero(raw == 10)

    def lines(self) -> tuple[np.ndarray, ...]:
        """(first word, word after the last, first byte, byte after the line's end) of each line with words."""
        line = np.searchsorted(self.newlines, self.starts)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        after = np.append(first[1:], len(line)) if len(first) else first
        number = line[first]
        begin = np.where(number > 0, self.newlines[number - 1] + 1, 0)
        # the last line of a text has no line end of its own
        end = np.minimum(self.newlines[number] + 1, self.text_ends[self.text[first]])
        return first, after, begin, end

    def pieces(self, reach: int = CUT_REACH) -> tuple[np.ndarray, ...]:
        """The same of the pieces between content-defined cuts; blanks belong to what is before."""
        n = len(self.hashes)
        before = np.concatenate((np.zeros(1, np.uint64), self.hashes[:-1])) if n else self.hashes
        h = _mixed(self.hashes + before * _STEP)
        counts = np.bincount(self.text, minlength=len(self.text_ends))
        last = np.cumsum(counts)[self.text]
        place = np.arange(n)
        cut = (place - (last - counts[self.text]) >= reach) & (last - place > reach)
        for k in range(1, min(reach, n - 1) + 1):
            cut[k:] &= h[k:] < h[:-k]
            cut[:-k] &= h[:-k] < h[k:]
        cut[np.flatnonzero(np.diff(self.text, prepend=-1))] = True
        first = np.flatnonzero(cut)
        after = np.append(first[1:], n) if len(first) else first
        begin = self.starts[first]
        same = np.append(self.text[first[1:]] == self.text[first[:-1]], False) if len(first) else np.zeros(0, bool)
        end = np.where(same, np.append(begin[1:], 0), self.text_ends[self.text[first]]) if len(first) else begin
        return first, after, begin, end


class Signer:
    """Digests of runs of words, and band hashes of their shingles; the permutations are fixed by the seed."""

    def __init__(self, bands: int, rows: int):
        random = np.random.default_rng(7)
        self.bands, self.rows = bands, rows
        self.a = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | _U64(1)
        self.b = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.keys = [(_U64(x | 1), _U64(pow(x | 1, -1, 1 << 64))) for x in (0xC2B2AE3D27D4EB4E, 0x165667B19E3779F8)]

    def digests(self, hashes: np.ndarray, first: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        """Two independent hashes of each run."""
        out = []
        for step, unstep in self.keys:
            sums, inverses = _sums(hashes, step, unstep)
            out.append(_mixed((sums[after] - sums[first]) * inverses[first] + (after - first).astype(np.uint64) * _SPREAD))
        return out

    def __call__(
        self, hashes: np.ndarray, first: np.ndarray, after: np.ndarray, bands: int, kind: int = 0
    ) -> np.ndarray:
        """The first bands of each run of `SHINGLE` words or more, a row per run; kinds never meet."""
        if not len(first):
            return np.zeros((0, bands), np.int64)
        n = len(hashes) - SHINGLE + 1
        shingle = np.zeros(n + 1, np.uint64)
        for k in range(SHINGLE):
            shingle[:-1] = (shingle[:-1] + hashes[k : k + n]) * _STEP
        shingle = _mixed(shingle)
        edges = np.stack((first, after - SHINGLE + 1), 1).ravel()
        out = np.zeros((len(first), bands), np.uint64)
        for band in range(bands):
            value = np.full(len(first), band + (kind << 32), np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                mixed = shingle * self.a[k] + self.b[k]
                mixed ^= mixed >> _U64(29)
                value = _mixed((value + np.minimum.reduceat(mixed, edges)[::2]) * _STEP)
            out[:, band] = value
        return out.view(np.int64)


_FOUND = [
    StructField("start", LongType(), False), StructField("end", LongType(), False),
    StructField("n_words", IntegerType(), False), StructField("line", BooleanType(), False),
    StructField("k1", LongType(), False), StructField("k2", LongType(), False),
    StructField("bands", ArrayType(LongType(), False), False),
]


def _signed(texts: list[bytes], sign: Signer, min_words: int, passages: bool) -> list[pa.Array]:
    """Text number and the columns of `_FOUND` for the paragraphs of some texts."""
    words, parts = Words(texts), []
    for line, runs, least, bands in (
        (True, words.lines(), min_words, sign.bands),
        *(((False, words.pieces(), PASSAGE_WORDS, min(PASSAGE_BANDS, sign.bands)),) if passages else ()),
    ):
        long = runs[1] - runs[0] >= max(least, SHINGLE)
        first, after, begin, end = (x[long] for x in runs)
        text = words.text[first] if len(first) else first
        at = words.text_starts[text] if len(first) else begin
        k1, k2 = sign.digests(words.hashes, first, after)
        # equal paragraphs need their bands once; this is the combine before the shuffle
        shown = np.zeros(len(first), bool)
        shown[np.unique(k1, return_index=True)[1]] = True
        found = sign(words.hashes, first[shown], after[shown], bands, 0 if line else 1)
        offsets = np.concatenate(([0], np.cumsum(shown * bands))).astype(np.int32)
        parts.append([
            pa.array(text), pa.array(begin - at, pa.int64()), pa.array(end - at, pa.int64()),
            pa.array((after - first).astype(np.int32)), pa.array(np.full(len(first), line)),
            pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel())),
        ])
    return [pa.concat_arrays(list(columns)) for columns in zip(*parts)]


def _paragraphs(
    docs: DataFrame, doc_id: str, text: str, min_words: int, bands: int, rows: int, passages: bool
) -> DataFrame:
    """(_id, _row, start, end, n_words, line, k1, k2, bands) of every paragraph that is long enough."""
    schema = StructType([docs.select(F.col(doc_id).alias("_id")).schema["_id"], StructField("_row", LongType()), *_FOUND])
    arrow = to_arrow_schema(schema)
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(bands, rows)
        for batch in batches:
            for part in slices(batch, [2], batch.num_rows, SLICE_BYTES):
                texts = [(t or "").encode() for t in part.column(2).to_pylist()]
                number, *found = _signed(texts, sign, min_words, passages)
                columns = [part.column(0).take(number), part.column(1).take(number), *found]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        release_memory()

    return _named(docs, doc_id, text).mapInArrow(run, schema)


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, _row, _text): rows of one id and text have one key, whatever else they hold."""
    named = docs.filter(F.col(doc_id).isNotNull())
    return named.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text"))


def _line_texts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(k1, line) for rows (k1, _id, _row, start, end) of `wanted`, by way of their documents."""
    per_doc = wanted.groupBy("_id", "_row").agg(F.collect_list(F.struct("start", "end", "k1")).alias("places"))
    n = wanted.count()
    per_doc = F.broadcast(per_doc) if n <= BROADCAST_ROWS else per_doc
    lines = _named(docs, doc_id, text).join(per_doc, ["_id", "_row"])
    lines = lines.select(F.explode("places").alias("p"), F.col("_text").cast("binary").alias("bytes"))
    length = (F.col("p.end") - F.col("p.start")).cast("int")
    line = F.substring("bytes", (F.col("p.start") + 1).cast("int"), length).cast("string")
    return lines.select("p.k1", line.alias("line")).dropDuplicates(["k1"])


def _words(line: str) -> list[bytes]:
    return line.encode().lower().split()


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    def jaccard(x: str, y: str) -> bool:
        a, b = shingles(_words(x)), shingles(_words(y))
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common >= similarity * (len(a) + len(b) - common)

    added = StructType([StructField("same", BooleanType(), False)])
    make = lambda: lambda xs, ys: [(jaccard(x, y),) for x, y in zip(xs, ys)]
    return map_rows(pairs, ["a", "b"], ["x", "y"], added, make).filter("same").select("a", "b")


def _forest(near: np.ndarray, roots: list[int]) -> list[tuple[int, int]]:
    """Links between roots that connect what `near` connects."""
    links, left = [], np.arange(len(roots))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            hit = near[node, left]
            found, left = left[hit].tolist(), left[~hit]
            links += [(roots[node], roots[x]) for x in found if roots[node] != roots[x]]
            frontier += found
    return links


def _common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many hashes each two of the sets share."""
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = n > 1
    numbers = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], numbers[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        held = np.zeros((len(sets), min(width, int(shared.sum()) - start)), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def _open_groups(members: DataFrame, group: int) -> DataFrame:
    """(h, x, y, k1, root): groups (h, x, y) in which every two members (h, k1, root) meet.

    Two of one bucket meet if their roots differ. A root with many members has blocks of its
    own, so no block is paired with another of the same single root.
    """
    half = max(group // 2, 1)
    sizes = members.groupBy("h", "root").agg(F.count("*").alias("n"))
    few = F.sum(F.when(F.col("n") <= half, F.col("n")).otherwise(0)).alias("few")
    mixed = sizes.groupBy("h").agg(F.sum("n").alias("total"), few, F.count("*").alias("roots")).filter("roots > 1")
    sizes = saved(sizes.join(mixed, "h").select("h", "root", "n", "total", "few"), "sizes")
    n_sizes = sizes.count()
    parts = lambda n: F.ceil(n / half)
    of_root = F.xxhash64("root", F.pmod(F.xxhash64("k1"), parts(F.col("n"))))
    of_few = F.xxhash64(F.lit("few"), F.pmod(F.xxhash64("root"), F.greatest(parts(F.col("few")), F.lit(1))))
    block = F.when(F.col("total") <= group, F.lit(0).cast("long")).when(F.col("n") > half, of_root).otherwise(of_few)
    members = members.join(F.broadcast(sizes) if n_sizes <= BROADCAST_ROWS else sizes, ["h", "root"])
    members = saved(members.select("h", "k1", "root", block.alias("block")), "members")
    blocks = members.groupBy("h", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    x = blocks.select("h", F.col("block").alias("x"), "lo", "hi")
    y = blocks.select("h", F.col("block").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    met = x.join(y, "h").filter((F.col("x") <= F.col("y")) & (F.least("lo", "lo_y") < F.greatest("hi", "hi_y")))
    met = met.select("h", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return members.join(met, ["h", "block"]).select("h", "x", "y", "k1", "root")


def _open_links(groups: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the roots of members (h, x, y, k1, root) of a group that are similar."""

    def link(table: pa.Table) -> pa.Table:
        roots = table["root"].to_pylist()
        sets = [shingles(_words(line)) for line in table["line"].to_pylist()]
        common = _common(sets)
        sizes = np.array([len(s) for s in sets])
        near = common >= similarity * (sizes[:, None] + sizes - common)
        own = np.array(roots)
        links = _forest(near | (own[:, None] == own), roots)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    importable(groups.sparkSession)
    shown = groups.join(lines, "k1").select("h", "x", "y", "root", "line")
    return shown.groupBy("h", "x", "y").applyInArrow(link, "a long, b long")


def repeated_paragraphs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    min_words: int = MIN_WORDS, similarity: float = SIMILARITY, passages: bool = False,
) -> DataFrame:
    """(_id, _row, start, end, n_words, line, root, first_id, keep) of every paragraph whose cluster has several.

    Places are bytes. `root` names the cluster, `first_id` the document of its first occurrence.
    """
    bands, rows = tune_bands(similarity)
    place = ("_id", "_row", "start", "end")
    every = saved(_paragraphs(docs, doc_id, text, min_words, bands, rows, passages), "paragraphs")
    # a text that is there twice under one id is one document
    at = F.xxhash64(*place)
    nodes = every.groupBy("k1", "k2").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    repeated = saved(nodes.filter("a <> b").select("k1").distinct(), "repeated")
    # a band's hash is seeded by its number, so it names the bucket; mixed with it, the key of a
    # member has another order in every bucket, and mixing again gives the key back. Few buckets
    # have two members: they are dealt out once, as they are, and not combined before
    buckets = every.select("k1", F.explode("bands").alias("h")).repartition("h")
    mixed = F.col("k1").bitwiseXOR(F.col("h"))
    centres = buckets.groupBy("h").agg(F.min(mixed).alias("a"), F.max(mixed).alias("b"), F.count("*").alias("n"))
    centres = centres.filter("a <> b").select(
        "h", F.col("a").bitwiseXOR(F.col("h")).alias("a"), F.col("b").bitwiseXOR(F.col("h")).alias("b"), "n"
    )
    members = saved(buckets.join(centres, "h"), "members")
    met = members.select("k1", F.explode(F.array("a", "b")).alias("c"))
    pairs = met.filter(F.col("k1") != F.col("c")).select(
        F.least("k1", "c").alias("a"), F.greatest("k1", "c").alias("b")
    )
    pairs = saved(pairs.distinct(), "pairs")
    needed = saved(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct(), "needed")
    wanted = _of_keys(every, needed).dropDuplicates(["k1"]).select("k1", *place)
    lines = saved(_line_texts(docs, doc_id, text, saved(wanted, "wanted")), "lines")
    shown = pairs.join(lines.select(F.col("k1").alias("a"), F.col("line").alias("x")), "a")
    shown = shown.join(lines.select(F.col("k1").alias("b"), F.col("line").alias("y")), "b")
    roots = components(_verified(shown, similarity), "a", "b")
    # the centres have met all others of their bucket: two members besides them may be open
    crowded = members.filter("n > 3 AND k1 <> a AND k1 <> b").select("h", "k1")
    more = None
    if not crowded.isEmpty():
        rest = crowded.distinct().join(roots, crowded["k1"] == roots["node"], "left")
        rest = saved(rest.select("h", "k1", F.coalesce("root", "k1").alias("root")), "rest")
        more = components(_open_links(_open_groups(rest, GROUP), lines, similarity), "a", "b")
        more = more.select(F.col("node").alias("root"), F.col("root").alias("joined"))
    classes = repeated.union(roots.select("node")).union(more.select("root") if more else repeated.limit(0)).distinct()
    classes = classes.join(roots, classes["k1"] == roots["node"], "left").select("k1", F.coalesce("root", "k1").alias("root"))
    if more:
        classes = classes.join(more, "root", "left").select("k1", F.coalesce("joined", "root").alias("root"))
    found = _of_keys(every, saved(classes, "classes")).select(*place, "n_words", "line", "root")
    found = saved(found, "found")
    clusters = found.groupBy("root").agg(
        F.min(F.struct(*place)).alias("first"), F.min(at).alias("a"), F.max(at).alias("b")
    )
    clusters = saved(clusters.filter("a <> b").select("root", "first"), "clusters")
    found = found.join(clusters, "root")
    # a line and a piece of it can be alike: what overlaps the first occurrence is that occurrence
    there = (F.col("_id") == F.col("first._id")) & (F.col("_row") == F.col("first._row"))
    keep = there & (F.col("start") < F.col("first.end")) & (F.col("end") > F.col("first.start"))
    return found.select(*place, "n_words", "line", "root", F.col("first._id").alias("first_id"), keep.alias("keep"))


def _of_keys(every: DataFrame, keys: DataFrame) -> DataFrame:
    """The paragraphs whose `k1` is among the keys of a saved table of longs."""
    n = keys.count()
    return every.drop("bands").join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, "k1")


def removed_spans(repeats: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _row, start, end, n, kept_in) of the runs of paragraphs to remove.

    Paragraphs that touch or overlap make a run. A run without a line needs `min_words` words.
    """
    order = Window.partitionBy("_id", "_row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= reached, 0).otherwise(1)
    # equal rows have their paragraphs once
    once = repeats.dropDuplicates(["_id", "_row", "start", "end"])
    runs = once.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    spans = runs.groupBy("_id", "_row", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"),
        F.collect_set("first_id").alias("kept_in"), F.sum("n_words").alias("n_words"), F.max("line").alias("line"),
    )
    return spans.filter(F.col("line") | (F.col("n_words") >= min_words)).drop("_run", "n_words", "line")


def _without(text: str, spans: str) -> Column:
    """A text without some spans of bytes, sorted and apart; with its last line goes the line end before."""
    whole = F.col(text).cast("binary")

    def piece(start: Column, end: Column) -> Column:
        return F.substring(whole, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    before = F.transform(
        spans, lambda s, k: piece(F.when(k > 0, F.get(F.col(spans), k - 1)["end"]).otherwise(F.lit(0)), s["start"])
    )
    size, last = F.octet_length(whole).cast("bigint"), F.element_at(spans, -1)["end"]
    kept = F.concat(F.array_join(before, ""), piece(last, size))
    return F.when(last == size, F.regexp_replace(kept, r"\n\z", "")).otherwise(kept)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    min_words: int = MIN_WORDS, similarity: float = SIMILARITY, passages: bool = False,
) -> DataFrame:
    """The documents without repeated paragraphs, with `n_removed` and `kept_in`.

    `kept_in` lists the documents that keep what this one lost. All rows are returned. Without
    `passages` only whole lines are paragraphs.
    """
    docs = docs.drop("n_removed", "kept_in")
    repeats = repeated_paragraphs(docs, doc_id, text, min_words, similarity, passages).filter("NOT keep")
    spans = removed_spans(repeats, min_words)
    removed = spans.groupBy(F.col("_id").alias("_lost"), F.col("_row").alias("_lost_row")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"),
        F.sum("n").alias("_n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"),
    )
    removed = saved(removed, "removed")
    numbers = removed.agg(F.sum(F.size("_spans"))).first()[0] or 0
    removed = F.broadcast(removed) if numbers <= BROADCAST_ROWS else removed
    same = (docs[doc_id] == removed["_lost"]) & (F.xxhash64(docs[text]) == removed["_lost_row"])
    joined = docs.join(removed, same, "left")
    shorter = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(_without(text, "_spans"))
    kept = [shorter.alias(c) if c == text else docs[c] for c in docs.columns]
    id_type = docs.schema[doc_id].dataType.simpleString()
    return joined.select(
        *kept,
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_in", F.array().cast(f"array<{id_type}>")).alias("kept_in"),
    )
