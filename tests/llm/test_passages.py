"""Passages inside and across lines: the pieces of paragraph dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.llm import paragraphs
from trailspark.llm.paragraphs import Signer, Words, remove_repeats


def noise(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 7))) for _ in range(n)]


def texts(n: int) -> list[bytes]:
    rnd = random.Random(3)
    rows = [b"", b"   ", b"one", b"\n\n", b"a " * 400, "é漢 😀\t x\r\ny".encode(), b"\nlead " + b"w " * 30 + b"\n  \n tail"]
    for _ in range(n):
        words = noise(rnd, rnd.randint(0, 300))
        rows.append("".join(w + rnd.choice([" ", "\n", "  ", " \n\n"]) for w in words).encode())
    return rows


def test_words_lines_and_pieces():
    rows = texts(60)
    words = Words(rows)
    alone = [Words([t]) for t in rows]
    assert [int(h) for w in alone for h in w.hashes] == words.hashes.tolist()
    at = 0
    for k, t in enumerate(rows):
        own = [t[a:b] for a, b in zip(alone[k].starts, alone[k].ends)]
        assert own == t.split()
        found = {}
        for name, runs in (("lines", words.lines()), ("pieces", words.pieces())):
            mine = [r for r in zip(*runs) if words.text[r[0]] == k]
            # the same whatever other texts are signed together with it
            assert [(a - at, b - at, c - words.text_starts[k], d - words.text_starts[k]) for a, b, c, d in mine] == list(
                zip(*getattr(alone[k], name)())
            )
            found[name] = [(t[c - words.text_starts[k] : d - words.text_starts[k]], b - a) for a, b, c, d in mine]
        assert [x for x, _ in found["lines"]] == [x for x in t.splitlines(keepends=True) if x.split()] or b"\r" in t
        assert b"".join(x for x, _ in found["pieces"]) == (t[alone[k].starts[0] :] if own else b"")
        assert all(len(x.split()) == n for kind in found.values() for x, n in kind)
        at += len(own)


def brute_pieces(hashes: list[int], reach: int) -> list[int]:
    """Where pieces begin: at words whose bigram hash is less than `reach` on both sides."""
    n, mask = len(hashes), (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 29)

    h = [mixed((b + (hashes[k - 1] if k else 0) * 0x9E3779B97F4A7C15) & mask) for k, b in enumerate(hashes)]
    inner = [
        k for k in range(reach, n - reach)
        if all(h[k] < h[j] for j in range(k - reach, k + reach + 1) if j != k)
    ]
    return [0, *inner] if n else []


def test_pieces_by_brute_force():
    for t in texts(40):
        words = Words([t])
        assert words.pieces()[0].tolist() == brute_pieces(words.hashes.tolist(), paragraphs.CUT_REACH)


def test_equal_words_have_equal_digests_and_bands():
    sign = Signer(*paragraphs.tune_bands())
    a, b = Words([b"x y The quick brown fox\njumps over it all  z"]), Words([b"the QUICK brown\tfox jumps over it all"])
    runs = [(a, np.array([2]), np.array([10])), (b, np.array([0]), np.array([8]))]
    digests = [[int(k[0]) for k in sign.digests(w.hashes, f, e)] for w, f, e in runs]
    assert digests[0] == digests[1] and digests[0][0] != digests[0][1]
    bands = [sign(w.hashes, f, e, 5).tolist() for w, f, e in runs]
    assert bands[0] == bands[1]
    other = Words([b"the quick brown fox jumps over all it"])
    assert [int(k[0]) for k in sign.digests(other.hashes, np.array([0]), np.array([8]))] != digests[0]


def test_bands_estimate_the_similarity():
    """Sets of similarity s agree in a band of r rows with probability s^r."""
    rnd = random.Random(9)
    sign = Signer(10, 3)
    hits = total = 0
    for _ in range(300):
        base = noise(rnd, 60)
        other = list(base)
        other[rnd.randrange(60)] = "changed"
        pair = [Words([" ".join(w).encode()]) for w in (base, other)]
        sets = [set(paragraphs.shingles(" ".join(w).encode().split()).tolist()) for w in (base, other)]
        similar = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        bands = [sign(w.hashes, np.array([0]), np.array([60]), 10)[0] for w in pair]
        hits += (bands[0] == bands[1]).mean() - similar**3
        total += 1
    assert abs(hits / total) < 0.03


@pytest.fixture(scope="module")
def corpus():
    """Clean texts, and passages of 51 to 90 words inside other lines, across lines and wrapped."""
    rnd = random.Random(11)
    rows, planted = [], set()
    passages = [noise(rnd, n) for n in range(51, 91, 2)]
    for k in range(400):
        words = noise(rnd, rnd.randint(5, 200))
        if k % 4 == 0:
            passage = list(passages[k // 4 % len(passages)])
            if k % 3 == 0:
                passage = [w + "\n" if n % 6 == 5 else w for n, w in enumerate(passage)]
            if k % 3 == 1:
                passage[25] = passage[25].upper() + "\n"
            cut = rnd.randint(0, len(words))
            words[cut:cut] = passage
            if k // 4 >= len(passages):
                planted.add(k)
        text = " ".join(words)
        rows.append((k, text, "x"))
    return rows, planted, passages


def test_passages_wherever_they_stand(spark, corpus):
    rows, planted, _ = corpus
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept_in string"), passages=True).collect()
    caught = {r.doc_id for r in got if r.n_removed}
    assert len(caught & planted) >= 0.95 * len(planted) and caught <= planted
    given = {k: t for k, t, _ in rows}
    for r in got:
        before, after = given[r.doc_id].split(), r.text.split()
        if r.n_removed == 0:
            assert r.text == given[r.doc_id]
            continue
        # what is gone is one run of the passage, of the least length or more
        assert len(before) - len(after) >= paragraphs.MIN_WORDS and all(k < r.doc_id for k in r.kept_in)
        start = next(n for n in range(len(before)) if after[:n] != before[:n] or n == len(after)) if after else 0
        assert any(before[:n] + before[n + len(before) - len(after) :] == after for n in range(max(0, start - 2), start + 1))


def test_cases(spark):
    rnd = random.Random(12)
    passage, lead, tail = (" ".join(noise(rnd, n)) for n in (70, 30, 30))
    rows = [
        (1, f"{lead} {passage} {tail}"), (5, passage), (5, f"own words of this one {tail[:40]}"), (5, passage), (None, passage),
        (6, None), (7, ""), (8, "z " * 50_000), (9, "z " * 50_000), (10, f"{'q ' * 3}" + " ".join(noise(rnd, 200_000))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs, passages=True).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [rows[0][1]] and texts[None] == [passage] and texts[6] == [None] and texts[7] == [""]
    # rows with one id: the clean one stays whole, the copies lose what document 1 has
    assert rows[2][1] in texts[5]
    assert all(len(t.split()) <= 40 for t in texts[5] if t != rows[2][1])
    assert texts[8] == [rows[7][1]] and texts[9] != [rows[8][1]] and texts[10] == [rows[9][1]]
    assert remove_repeats(docs.limit(0), passages=True).count() == 0


def test_one_passage_in_most_documents(spark):
    """A hot passage: every document but the first loses it, and nobody else is touched."""
    rnd = random.Random(13)
    passage = " ".join(noise(rnd, 80))
    rows = [(k, " ".join(noise(rnd, 40)) + " " + (passage if k % 3 else "") + " " + " ".join(noise(rnd, 40))) for k in range(600)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), passages=True)
    removed = {r.doc_id for r in got.filter(F.col("n_removed") > 0).collect()}
    assert removed == {k for k in range(2, 600) if k % 3}


def test_slices_are_bounded_in_bytes():
    import pyarrow as pa

    from trailspark.llm.batches import slices

    values = ["a" * n for n in (5, 0, 200, 1, 1, 1, 30, 30, 30, 30)] + [None, None]
    batch = pa.RecordBatch.from_pydict({"t": values, "ids": [[1] * n for n in range(12)]})
    for rows, size in ((3, None), (100, 50), (2, 60), (100, 1), (100, 10_000)):
        parts = list(slices(batch, [0], rows, size))
        assert [v for p in parts for v in p.column(0).to_pylist()] == values
        for p in parts:
            held = sum(len(v or "") for v in p.column(0).to_pylist())
            assert p.num_rows <= rows and (size is None or held <= size or p.num_rows == 1)
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) * 8 <= 100 for p in slices(batch, [1], 100, 100))
