"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_operators import brute_fingerprint, classes
from tests.llm.test_passages import brute_pieces
from trailspark.llm.oracles import QUALITY
from trailspark.llm.paragraphs import CUT_REACH, PASSAGE_BANDS, Signer, Words, tune_bands
from trailspark.llm.queries import RANKS


def paragraph_places(text: str) -> list[tuple[int, int, bool]]:
    """(first byte, byte after, line) of lines of twenty words and of pieces of eight."""
    data, places, at = text.encode(), [], 0
    for line in data.split(b"\n"):
        if len(line.split()) >= 20:
            places.append((at, min(at + len(line) + 1, len(data)), True))
        at += len(line) + 1
    starts = [m.start() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", data)]
    cuts = brute_pieces(Words([data]).hashes.tolist(), CUT_REACH)
    for k, n in zip(cuts, [*cuts[1:], len(starts)]):
        if n - k >= 8:
            places.append((starts[k], starts[n] if n < len(starts) else len(data), False))
    return places


def shortened(texts: dict[int, str]) -> dict[int, str]:
    """Without repeated lines and passages: paragraphs of a Jaccard similarity of 0.8, by single linkage.

    Pieces that are alike but not equal link where they meet in their band, lines always.
    """
    sets, words, band = {}, {}, {}
    sign = Signer(*tune_bands())
    for d, t in texts.items():
        for place in paragraph_places(t):
            w = t.encode()[place[0] : place[1]].lower().split()
            sets[d, *place] = frozenset(b" ".join(w[k : k + 5]) for k in range(len(w) - 4))
            words[d, *place] = len(w)
            if not place[2]:
                run = np.array([0]), np.array([len(w)])
                band[d, *place] = sign(Words([b" ".join(w)]).hashes, *run, PASSAGE_BANDS, 1).tolist()
    links, seen = [], collections.defaultdict(list)
    for key, s in sets.items():
        shared = collections.Counter(k for x in s for k in seen[x])
        links += [
            (key, k) for k, n in shared.items()
            if n >= 0.8 * (len(s) + len(sets[k]) - n) and (s == sets[k] or band.get(key, 0) == band.get(k, 0))
        ]
        for x in s:
            seen[x].append(key)
    gone = collections.defaultdict(set)
    for members in classes(links, sets):
        d, start, end, _ = min(members, key=lambda k: k[:3])
        for other, a, b, line in members:
            if not (other == d and a < end and b > start):
                gone[other].add((a, b, line, words[other, a, b, line]))
    out = dict(texts)
    for d, places in gone.items():
        runs: list[list] = []
        for a, b, line, n in sorted(places):
            if runs and a <= runs[-1][1]:
                runs[-1] = [runs[-1][0], max(b, runs[-1][1]), line or runs[-1][2], n + runs[-1][3]]
            else:
                runs.append([a, b, line, n])
        data, kept, at = texts[d].encode(), b"", 0
        runs = [r for r in runs if r[2] or r[3] >= 20]
        for a, b, _, _ in runs:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        out[d] = (kept.removesuffix(b"\n") if runs and runs[-1][1] == len(data) else kept).decode()
    return out


def test_pipeline(spark, sf_dir):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({QUALITY.format(docs='documents')}) WHERE kept").fetchall()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.doc_id in kept}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    texts = {min(c): texts[min(c)] for c in classes(near, texts)}
    texts = shortened(texts)
    items = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = [{tuple(w[k : k + 8]) for k in range(len(w) - 7)} for w in items]
    for d in list(texts):
        words = texts[d].split()
        own = {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
        if any(g and len(g & own) >= 0.5 * len(g) for g in grams):
            del texts[d]
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {d: encoding.encode_ordinary(t) for d, t in texts.items()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == {
        d: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for d, ids in wanted.items()
    }
    assert {r.doc_id: r.decoded_sha256 for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}


def test_stages_of_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_cases_of_the_stages(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, extra columns with the names of added ones."""
    rnd = random.Random(21)
    clean = lambda n: " ".join("the of and house river stone walk over green light".split()[k % 10] + str(rnd.randrange(900)) + " the" for k in range(n))
    long = clean(60_000)
    rows = [(1, clean(40)), (2, None), (3, ""), (4, clean(50)), (5, long), (None, clean(45))]
    rows += [rows[0], (4, clean(42))]
    schema = "doc_id long, text string, lang string, n_chars int, kept string, n_removed string, contaminated string, simhash string"
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), "a", "b", "c", "d") for i, t in rows], schema).repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema, name
        seen[name] = sorted(((r.doc_id, r.text, r.n_chars, r.kept + r.n_removed + r.contaminated + r.simhash) for r in out.collect()), key=repr)
        assert all(x[3] == "abcd" for x in seen[name])
    texts = {name: [(x[0], x[1]) for x in rows_] for name, rows_ in seen.items()}
    assert sorted(texts["quality rules"], key=repr) == sorted(((i, t) for i, t in rows if t), key=repr)
    assert sorted({i for i, _ in texts["simhash near-dedup"] if i is not None}) == [1, 2, 4, 5]
    assert sorted(texts["substring dedup"], key=repr) == sorted(rows, key=repr)
    assert sorted(texts["benchmark decontamination"], key=repr) == sorted(rows, key=repr)
    last = stages["byte-level bpe"](spark, docs, sf_dir).collect()
    assert len(last) == len(rows) and {r.doc_id: r.n_tokens for r in last}[3] == 0
