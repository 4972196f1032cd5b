"""Byte-level BPE encoding and decoding as a reduction over a tree.

The encoding of a byte string is a monoid element: a list of token ids. A long piece is cut in
halves that are encoded recursively, and two neighbours are joined by encoding a window of
tokens around the seam anew. A sequence of tokens is the encoding of its bytes exactly when
every two adjacent tokens stand side by side in the encoding of their own two byte strings,
so the window is right as soon as its outer tokens pass that test against the tokens just
outside; until then it grows. The leaves of a batch's trees are merged together, one step of
all leaves of a length at a time. Pieces (the matches of the pre-tokenizer) never merge with each
other, so higher up the tree joining is concatenation, of ids kept as the bytes of 32-bit numbers;
so is decoding at every height, and a batch's ids are decoded together.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts and pieces of any
length are encoded whole; null rows, repeated rows and empty tables need no special care, and
other columns are passed through.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from trailspark.llm.batches import map_rows

#: Strings up to this many bytes are merged directly.
LEAF_BYTES = 16
LEAF_MEMO_BYTES = 16
#: Encodings remembered per task: two generations of this many entries.
MEMO_ENTRIES = 100_000
#: Answers remembered about short strings of bytes and about pairs of tokens.
SEAM_ENTRIES = 60_000
#: Bytes of texts or ids handled at a time.
SLICE_BYTES = 2 << 20
MEMO_CHARS = 64

_BEFORE_BLANK = re.compile(r" (?!\S)")
_CHUNK_START = re.compile(r" (?=\S)")


def chunks(text: str) -> list[str]:
    """Cut at each space that a visible character follows; the space belongs to what follows.

    The pre-tokenizers here take such a space as the first character of a piece, so no piece
    crosses the cut. The first chunk stands without a space, all others after one.
    """
    if _BEFORE_BLANK.search(text) is None:
        return text.split(" ")
    return _CHUNK_START.split(text)


class Memo:
    """Values of chunks, computed for those not met lately; bounded in entries and their length."""

    def __init__(self, compute: Callable[[list[str]], list], entries: int = MEMO_ENTRIES):
        self.compute = compute
        self.entries = entries
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, lists: list[list[str]]) -> list[list]:
        """The values of the chunks in each list."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for chunk in set(chain.from_iterable(lists)).difference(young):
            value = old.get(chunk)
            if value is None:
                new.append(chunk)
            else:
                young[chunk] = value
        young.update(zip(new, self.compute(new)))
        values = [list(map(young.__getitem__, chunks)) for chunks in lists]
        for chunk in new:
            if len(chunk) > MEMO_CHARS:
                del young[chunk]
        return values


class ByteBpe:
    """`ranks` holds lines of a base64 token and its rank; a rank is the token's id."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.token_bytes = pa.array(self.tokens, pa.large_binary())
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        ids, size = self.ids, len(self.tokens)
        cuts = lambda token: ((token[:k], token[k:]) for k in range(1, len(token)))
        known = lambda left, right: left in ids and right in ids
        keys = np.fromiter(
            (ids[x] * (size + 1) + ids[y] for t in ids for x, y in cuts(t) if known(x, y)), np.int64
        )
        made = np.fromiter((r for t, r in ids.items() for x, y in cuts(t) if known(x, y)), np.int32)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ids = np.append(made[order], np.int32(size))
        self.byte_pairs = self.pair_ranks(
            np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        ).reshape(256, 256)
        self.pattern = regex.compile(pattern)
        self.memo = Memo(self.encode_chunks)
        self.leaves: dict[bytes, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, the leftmost first, until none is left."""
        ids = self.ids
        whole = ids.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.tokens)
        ranks = [ids.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = ids.get(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = ids.get(parts[at - 1] + parts[at], none)
        return [ids[p] for p in parts]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each two tokens make together; one past the last for none.

        One past the last also stands for no token, which makes none with any.
        """
        keys = left.astype(np.int64) * (len(self.tokens) + 1) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], np.int32(len(self.tokens)))

    def merge_all(self, strings: Iterable[bytes]) -> dict[bytes, bytes]:
        """`merge` of many strings, as bytes of ids, one step of all those of a length at a time."""
        found: dict[bytes, bytes] = {b"": b""}
        by_length: dict[int, list[bytes]] = {}
        for data in strings:
            whole = self.ids.get(data)
            if whole is not None:
                found[data] = whole.to_bytes(4, sys.byteorder)
            elif data:
                by_length.setdefault(len(data), []).append(data)
        for length, group in by_length.items():
            ids, sizes = self._merge_group(np.frombuffer(b"".join(group), np.uint8).reshape(-1, length).T)
            flat, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            found.update(zip(group, (flat[a:b] for a, b in zip([0, *ends], ends))))
        return found

    def _merge_group(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the columns, one after the other, and how many each has.

        A token keeps the place of its first byte, and names the places of its neighbours; the
        place past the end holds no token. `keys` orders the pairs that begin at each place by
        rank and place.
        """
        length, n = data.shape
        none, bits = len(self.tokens), length.bit_length()
        dead = np.int64(none) << bits
        tokens = np.full((length + 1, n), none, np.int32)
        tokens[:-1] = self.byte_ids[data]
        places = np.arange(length + 1)[:, None]
        keys = np.full((length + 1, n), dead)
        keys[:-2] = (self.byte_pairs[data[:-1], data[1:]].astype(np.int64) << bits) + places[:-2]
        after = np.repeat(places + 1, n, axis=1)
        before = np.repeat(places - 1, n, axis=1)
        before[0] = length
        live = np.ones((length, n), bool)
        tokens, flat_keys, after, before, flat_live = (x.reshape(-1) for x in (tokens, keys, after, before, live))
        while True:
            best = keys.min(axis=0)
            names = np.flatnonzero(best < dead)
            if not len(names):
                break
            best = best[names]
            place, made = best & ((1 << bits) - 1), best >> bits
            at = place * n + names
            gone = after[at] * n + names
            next_place, last_place = after[gone], before[at]
            next_at, last_at = next_place * n + names, last_place * n + names
            tokens[at], flat_live[gone], flat_keys[gone] = made, False, dead
            after[at], before[next_at] = next_place, place
            ranks = self.pair_ranks(made, tokens[next_at]).astype(np.int64)
            flat_keys[at] = (ranks << bits) + place
            ranks = self.pair_ranks(tokens[last_at], made).astype(np.int64)
            flat_keys[last_at] = (ranks << bits) + last_place
        return tokens.reshape(length + 1, n)[:-1].T[live.T], live.sum(axis=0)

    def leaf(self, data: bytes) -> list[int]:
        """`merge`, remembered: short strings of bytes recur in most words."""
        known = self.leaves.get(data)
        if known is None:
            known = self.merge(data)
            if len(data) <= LEAF_MEMO_BYTES:
                if len(self.leaves) > SEAM_ENTRIES:
                    self.leaves.clear()
                self.leaves[data] = known
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > SEAM_ENTRIES:
                self.fits.clear()
            known = self.fits[key] = self.leaf(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            seam = b"".join(self.tokens[t] for t in chain(left[len(left) - i :], right[:j]))
            window = self.leaf(seam)
            grow_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + window + right[j:]
            i += i if grow_left else 0
            j += j if grow_right else 0

    def halves(self, data: bytes) -> list[bytes]:
        """The leaves of the tree over a piece."""
        if len(data) <= LEAF_BYTES:
            return [data]
        middle = len(data) // 2
        return self.halves(data[:middle]) + self.halves(data[middle:])

    def encode_piece(self, data: bytes, leaves: dict[bytes, bytes]) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return np.frombuffer(leaves[data], np.int32).tolist()
        middle = len(data) // 2
        return self.join(self.encode_piece(data[:middle], leaves), self.encode_piece(data[middle:], leaves))

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, as bytes; their leaves are merged together."""
        encoded = [piece.encode() for piece in pieces]
        long = [data for data in encoded if len(data) > LEAF_BYTES]
        short = (data for data in encoded if len(data) <= LEAF_BYTES)
        ids = self.merge_all({*short, *chain.from_iterable(map(self.halves, long))})
        for data in long:
            ids[data] = np.array(self.encode_piece(data, ids), np.int32).tobytes()
        return dict(zip(pieces, map(ids.__getitem__, encoded)))

    def encode_heads(self, texts: list[str]) -> list[bytes]:
        """The ids of each string, as bytes."""
        cut = list(map(self.pattern.findall, texts))
        known = self.encode_pieces(list(dict.fromkeys(chain.from_iterable(cut))))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of chunks that stand after a space, as bytes.

        The chunks in a row are a text whose pieces end where they do, so one search finds them.
        """
        pieces = self.pattern.findall("".join([" " + text for text in texts]))
        known = self.encode_pieces(list(dict.fromkeys(pieces)))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        cuts = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        stops = (np.searchsorted(cuts, ends) + 1).tolist()
        ids = list(map(known.__getitem__, pieces))
        return [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in zip([0, *stops], stops)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Nothing here makes cycles, so the collector would only walk the memo again and again."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [chunks(text) for text in texts]
        heads = self.encode_heads([first for first, *_ in cut])
        values = self.memo.look_up([rest for _, *rest in cut])
        return [np.frombuffer(b"".join([head, *ids]), np.int32) for head, ids in zip(heads, values)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids: those of all its tokens, side by side."""
        if not lists:
            return []
        joined = self.token_bytes.take(pa.array(np.concatenate(lists)))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, lists)])].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all([np.array(ids, np.int32)])[0]


_codecs: dict[tuple[int, str], ByteBpe] = {}


def _codec(ranks: bytes, pattern: str) -> ByteBpe:
    """One codec per worker process and vocabulary."""
    key = (hash(ranks), pattern)
    if key not in _codecs:
        _codecs[key] = ByteBpe(ranks, pattern)
    return _codecs[key]


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver; vocabularies are a few megabytes whatever the data."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Add `ids`: the token ids of the whole text."""

    def make():
        codec = _codec(ranks, pattern)
        return lambda texts: [(ids,) for ids in codec.encode_all([t or "" for t in texts])]

    added = StructType([StructField("ids", ArrayType(IntegerType(), False), False)])
    return map_rows(docs, [c for c in docs.columns if c != "ids"], [text], added, make, SLICE_BYTES)


def decode_ids(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """Add `decoded`: the bytes that the ids stand for."""

    def make():
        codec = _codec(ranks, pattern)
        return lambda lists: [(x,) for x in codec.decode_all([np.array(ids or [], np.int32) for ids in lists])]

    added = StructType([StructField("decoded", BinaryType(), False)])
    return map_rows(encoded, [c for c in encoded.columns if c != "decoded"], [ids], added, make, SLICE_BYTES)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Add `ids` and `decoded`: both directions in one pass, with one codec a task."""

    def make():
        codec = _codec(ranks, pattern)

        def both(texts):
            ids = codec.encode_all([t or "" for t in texts])
            return list(zip(ids, codec.decode_all(ids)))

        return both

    added = StructType(
        [StructField("ids", ArrayType(IntegerType(), False), False), StructField("decoded", BinaryType(), False)]
    )
    return map_rows(docs, [c for c in docs.columns if c not in added.names], [text], added, make, SLICE_BYTES)
