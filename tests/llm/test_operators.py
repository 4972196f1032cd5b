"""The operators against brute force, and their defined cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from trailspark.llm import content, licenses, paragraphs, simhash, suffixes
from trailspark.llm.bpe import ByteBpe, decode_ids, encode_texts, read_ranks, round_trip
from trailspark.llm.components import components
from trailspark.llm.decontaminate import decontaminate
from trailspark.llm.language_model import score_documents
from trailspark.llm.quality import quality_rules
from trailspark.llm.queries import RANKS, TOKENIZER
from trailspark.llm.suffixes import deep_shallow_sort, remove_repeated_strings
from trailspark.llm.token_counts import Counter, count_tokens, read_cache, tokenizer_bytes

PASSAGE = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, f"Intro line.\n{PASSAGE}\nend one", 7), (2, f"Other start\n{PASSAGE}\nend two", 7),
    (3, None, 7), (4, "", 7), (5, "same text here", 7), (5, "same text here", 7), (None, "no id", 7),
    (6, "x" * 5000, 7), (7, "é漢😀 <|endoftext|> 'll \n\n  tab\t", 7), (8, "Licensed under the GNU General Public License", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and a column that clashes with results."""
    schema = "doc_id long, text string, n_words int"
    return spark.createDataFrame(ROWS, schema)


@pytest.fixture(scope="module")
def encoding():
    lines = (line.split() for line in open(RANKS, "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    parts = ["a", "b", "=", "é", "漢", "😀", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "1", "23", "tion", " of", "xX"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [*texts, "=" * 3000, "ab" * 2000, "".join(rnd.choice("ab=") for _ in range(2000))]


def test_bpe_is_the_librarys(encoding):
    codec = ByteBpe(read_ranks(RANKS), public_tokenizers.PATTERN)
    for text in random_texts(600):
        ids = codec.encode(text)
        assert ids == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_searches_new_chunks_together(encoding):
    """Chunks not met before are cut into pieces by one search, wherever blanks stand between them."""
    codec = ByteBpe(read_ranks(RANKS), public_tokenizers.PATTERN)
    rnd = random.Random(11)
    parts = ["a", "E", "é", "漢", "😀", "'ll", "1", "²", ".", "\n", " \n", "\t ", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", " "]
    texts = [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(40)) for _ in range(50)]
    searched, findall = [], codec.pattern.findall

    class Pattern:
        def findall(self, text):
            searched.append(text)
            return findall(text)

    codec.pattern = Pattern()
    ids = codec.encode_all(["", *texts])
    assert [list(x) for x in ids] == [encoding.encode_ordinary(t) for t in ["", *texts]]
    assert len(searched) <= len(texts) + 2
    assert codec.decode_all(ids) == [t.encode() for t in ["", *texts]]
    assert codec.decode_all([]) == [] and codec.decode([]) == b""


def test_bpe_merges_of_each_length():
    """Strings merged side by side give what each gives by itself."""
    codec = ByteBpe(read_ranks(RANKS), public_tokenizers.PATTERN)
    rnd = random.Random(12)
    strings = {bytes(rnd.choice(b"aaathe in\xc3\xa9\n") for _ in range(rnd.randint(0, 40))) for _ in range(3000)}
    merged = codec.merge_all(strings)
    assert {s: np.frombuffer(merged[s], np.int32).tolist() for s in strings} == {s: codec.merge(s) if s else [] for s in strings}


def test_bpe_cases(docs, encoding):
    ranks = read_ranks(RANKS)
    done = decode_ids(encode_texts(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    rows = done.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert list(r.ids) == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    both = round_trip(docs, ranks, public_tokenizers.PATTERN).select(*done.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, done.collect()))
    assert round_trip(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    assert encode_texts(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_token_counts(spark, docs, tmp_path):
    library = Tokenizer.from_file(TOKENIZER)
    counter = Counter(".json", tokenizer_bytes(TOKENIZER))
    texts = [*random_texts(400), "<|endoftext|> x <|endoftext|>\n"]
    assert counter.count(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    cache = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, count_tokens(docs, TOKENIZER, cache).collect()), key=repr)
    stored = read_cache(spark, cache).count()
    assert stored == len({text or "" for _, text, _ in ROWS})
    again = sorted(map(tuple, count_tokens(docs, TOKENIZER, cache).collect()), key=repr)
    assert again == first and read_cache(spark, cache).count() == stored
    assert {t or "": n for _, t, _, n in first} == {
        t or "": len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in ROWS
    }


def test_sorting():
    rnd = random.Random(3)
    for _ in range(100):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) * rnd.randint(1, 30) for _ in range(rnd.randint(1, 40))]
        assert [strings[k] for k in deep_shallow_sort(strings)] == sorted(strings)


def brute_repeats(texts: list[bytes]) -> list[tuple[int, str]]:
    seen = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        gone = set()
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        out.append((len(gone), bytes(b for k, b in enumerate(t) if k not in gone)))
    return out


@pytest.mark.parametrize("group", [2000, 3])
def test_suffix_dedup(spark, docs, sf_dir, group, monkeypatch):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (group,))
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    for df in (docs.select("doc_id", "text", "n_words"), some):
        rows = df.collect()
        wanted = collections.Counter(
            (r.doc_id, n, kept) for r, (n, kept) in zip(rows, brute_repeats([(r.text or "").encode() for r in rows]))
        )
        got = remove_repeated_strings(df).collect()
        assert wanted == collections.Counter(
            (r.doc_id, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got
        )
    assert remove_repeated_strings(docs.limit(0)).count() == 0


def brute_fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(links, nodes) -> set[frozenset]:
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return {frozenset(g) for g in groups.values()}


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    texts = {d: t for d, t, _ in ROWS}
    for r in rows:
        assert r.simhash % (1 << 64) == brute_fingerprint(texts[r.doc_id])
    empty = {r.component_id for r in rows if r.doc_id in (3, 4)}
    assert empty == {3}
    kept = collections.Counter(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert set(kept.values()) == {1} and set(kept) >= {None, 1, 3, 5, 6, 7, 8} and 4 not in kept
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_every_near_pair_is_linked_by_deeper_tables(spark):
    rnd = random.Random(1)
    values = {rnd.getrandbits(64) & ~1023 | rnd.getrandbits(10) for _ in range(40)}
    base = rnd.getrandbits(64)
    values |= {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(12)) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "simhash long"), 3, bucket=20)
    got = classes([(r.a, r.b) for r in links.collect()], signed)
    array = np.array(signed, np.int64).view(np.uint64)
    near = [(signed[i], signed[j]) for i in range(len(signed)) for j in range(i) if int(array[i] ^ array[j]).bit_count() <= 3]
    assert got == classes(near, signed)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 7), (1, 2)]
    found = components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {r.node: r.root for r in found} == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 140)}


def test_paragraphs(docs):
    bands, rows = paragraphs.tune_bands()
    assert (1 - 0.8**rows) ** bands <= 0.001
    got = {r.doc_id: r for r in paragraphs.remove_repeats(docs).collect()}
    assert got[1].text == ROWS[0][1] and got[2].text == "Other start\nend two"
    assert list(got[2].kept_in) == [1] and got[3].text is None and got[None].text == "no id"
    assert paragraphs.remove_repeats(docs).count() == len(ROWS)
    assert paragraphs.remove_repeats(docs.limit(0)).count() == 0


def test_near_paragraphs(spark):
    changed = PASSAGE.replace("word30", "other")
    rows = [(1, PASSAGE), (2, "lead\n" + changed), (3, " ".join(f"z{k}" for k in range(60)))]
    got = paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: PASSAGE, 2: "lead", 3: rows[2][1]}


@pytest.mark.parametrize("group", [512, 24])
def test_every_pair_of_a_bucket_is_resolved(spark, group, monkeypatch):
    """Variants of one text, each with a twin: the centres of a bucket are mostly other variants."""
    monkeypatch.setattr(paragraphs, "GROUP", group)
    chance = random.Random(5)
    rows = []
    for k in range(600):
        words = [f"w{n}" for n in range(120)]
        for n in chance.sample(range(120), 4):
            words[n] = f"v{k}x{n}"
        rows.append((2 * k, " ".join(words)))
        for n in chance.sample([n for n in range(10, 110) if words[n][0] == "w"], 2):
            words[n] = f"t{k}x{n}"
        rows.append((2 * k + 1, " ".join(words)))
    sets = [set(paragraphs.shingles(t.encode().split()).tolist()) for _, t in rows]
    near = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    wanted = {min(c) for c in classes(near, range(len(rows)))}
    got = paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == wanted


def test_decontamination(spark, docs):
    question = "If Alice buys 12 apples for 3 kg each and Bob buys 12 pears how many does Alice have left over today"
    bench = spark.createDataFrame([(1, question), (2, "too short"), (3, None)], "item_id long, text string")
    changed = "Some words. If Maria buys 7 apples for 3 kg each and Tom buys 7 pears how many does Maria have left over today"
    mixed = "If Maria buys 7 apples for 3 kg each and Tom buys 9 pears how many does Greta have left over today"
    more = spark.createDataFrame([(20, changed, 1), (21, mixed, 1), (22, "x " + question, 1)], docs.schema)
    got = decontaminate(docs.union(more), bench).collect()
    assert len(got) == len(ROWS) + 3
    assert {r.doc_id: (list(r.item_ids), list(r.kinds)) for r in got if r.contaminated} == {
        20: ([1], ["reparameterised"]), 22: ([1], ["verbatim"])
    }
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_partial_edited_and_numeric_items(spark):
    long = " ".join(f"long{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80))
    short = "what makes the old river bend so sharply just below our town before reaching the wide open sea again"
    numbers = "1 2 3 5 8 13 21 34 55 89 144 233 377 610 987 1597 2584 4181"
    bench = spark.createDataFrame([(1, long), (2, short), (3, numbers)], "item_id long, text string")
    quote = " ".join(long.split()[20:34])
    edited = short.replace("below", "beyond")
    rows = [
        (1, f"start {quote} end"), (2, f"start {edited} end"), (3, f"row {numbers} end"),
        (4, "start " + " ".join(long.split()[20:32]) + " end"), (5, "row 2 2 3 5 9 13 22 34 56 89 145 233 378 610 988 1597"),
    ]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r.doc_id: list(r.item_ids) for r in got if r.contaminated} == {1: [1], 2: [2], 3: [3]}
    assert {k for r in got for k in r.kinds} == {"verbatim"}


def test_quality_cases(docs):
    rows = quality_rules(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_words == 0 and by_id[3].base_failed and not by_id[3].kept
    assert by_id[6].word_chars == 5000 and quality_rules(docs.limit(0)).count() == 0


def test_license_scan(docs):
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (rows[8].n_base, rows[8].first_word, rows[8].last_word, rows[8].base_labels) == (1, 4, 4, "gpl")
    assert (rows[3].n_words, rows[3].n_base, rows[3].first_word, rows[3].labels, rows[3].score) == (0, 0, None, "", 0.0)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_expressions():
    score = lambda e: licenses.evaluate(licenses.parse_expression(e))
    assert score("MIT OR GPL-3.0-only") == (0.1, {"mit", "gpl"})
    assert score("MIT AND GPL-3.0-only") == (0.8, {"mit", "gpl"})
    assert score("(MIT OR BSD-3-Clause) AND Apache-2.0")[0] == 0.15
    assert score("GPL-2.0-only WITH Classpath-exception-2.0")[0] < 0.8
    assert licenses.parse_expression("(MIT") is None and licenses.parse_expression("OR MIT") is None


def test_license_places():
    text = "CC BY, cc-by cc by! All rights reserved. general public license"
    n, places, first, last, base, _, _ = licenses.scan_text(licenses._automaton(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    wanted = [k for p in licenses.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    assert (n, places, first, last) == (len(words), len(wanted), min(wanted), max(wanted))
    assert base == "cc-by,gpl,reserved"


@pytest.fixture(scope="module")
def tree():
    return content.train()


def test_extraction_of_unseen_pages(tree):
    right = total = 0
    for page in content.made_pages(60, seed=77):
        nodes = content.parse(page)
        texts, labels = [n.text for n in nodes], content.labels_of(nodes)
        wanted = "\n".join(t for n, t, y in zip(nodes, texts, labels) if n.tag == "#text" and y)
        right += content.extract(tree, page) == wanted
        total += 1
    assert right >= 0.9 * total


def test_extraction_cases(spark, tree):
    page = "<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three <b>four</b>.<p>Five.</article><script>'<p>'</script>"
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, '<<<>><a "'), (5, "<div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = content.extract_pages(pages, model=tree).collect()
    assert len(got) == len(rows) and got[0] == got[1]
    assert got[0].text == "A & B\nOne two three four.\nFive." and got[0].n_chars == len(got[0].text)
    assert got[2].text == got[3].text == ""


def test_marginals_are_exact(tree):
    parents = [-1, 0, 0, 1, 1]
    features = [{"bias": 1.0}, {"tag nav": 1.0}, {"tag article": 1.0}, {"length": 1.0}, {"links": 1.0}]
    got, _ = tree.marginals(parents, features)
    weight = lambda k: math.exp(sum(tree.weights.get(n, 0) * v for n, v in features[k].items()))
    total, on = 0.0, [0.0] * 5
    for bits in range(32):
        y = [bits >> k & 1 for k in range(5)]
        p = math.prod(weight(k) if y[k] else 1.0 for k in range(5))
        p *= math.prod(math.exp(tree.edges[y[parents[k]]][y[k]]) for k in range(1, 5))
        total += p
        on = [o + p * y[k] for k, o in enumerate(on)]
    assert np.allclose(got, [o / total for o in on])


def test_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    extra = spark.createDataFrame([(1000, None, 0), (1001, "", 0), (None, "no id", 0)], docs.schema)
    docs = docs.union(extra).repartition(3)
    rows = score_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {d: (t or "").encode().lower().split() + [b""] for d, t in texts.items()}
    out = {d: zlib.crc32((str(d) if d is not None else "").encode()) % 10 == 0 for d in texts}
    c = collections.Counter(w for d in texts if not out[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in rows if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)
    assert score_documents(docs.limit(0)).count() == 0


def test_digest_of_ids(spark, sf_dir, encoding):
    from trailspark.llm.queries import op2_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_byte_bpe(spark, sf_dir).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(ids)
