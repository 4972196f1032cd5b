"""Fill-in-middle, WARC archives and centroid clustering against brute force, and their defined cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.plans import plan
from trailspark.llm import warc
from trailspark.llm.centroids import cluster_vectors, first_centroids, whole_vectors, with_inertia
from trailspark.llm.fill_middle import FillMiddle, fill_middle, restore_text
from trailspark.llm.queries import op12_warc, op13_centroids

# --- fill in middle ----------------------------------------------------------------------

CUT_ROWS = [
    (1, "Some words, and more.\nA second line é漢😀 end", "x"), (2, None, "x"), (3, "", "x"), (4, "has <S> inside", "x"),
    (5, "same text here", "x"), (5, "same text here", "x"), (None, "no id at all", "x"), (6, "$1 \\ ^ $ {2}", "x"),
    (7, "x" * 300_000, "x"), (8, "a b " * 250_000, "x"), (9, "\r\n\t\x00  ", "x"), (10, "<", "x"), (11, "<P", "x"),
    *((k, f"text number {k} of some, with 12 units < or <M", "x") for k in range(20, 120)),
]


def brute_cut(doc_id, text, how=FillMiddle()):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{how.seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in how.markers) or h3 % 100 >= how.rate:
        return n, "plain", text, None, None
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = how.markers
    if h4 % 100 < how.spm_rate:
        return n, "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", len(prefix), len(middle)
    return n, "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", len(prefix), len(middle)


@pytest.mark.parametrize("how", [FillMiddle(), FillMiddle("<|fim_prefix|>", "<|fim_suffix|>", "$1\\E", rate=100, spm_rate=50)])
def test_cut(spark, how):
    # the last column has the name of one that is added
    docs = spark.createDataFrame(CUT_ROWS, "doc_id long, text string, form string")
    cut = fill_middle(docs, how).withColumn("restored", restore_text(F.col("output"), F.col("form"), how))
    rows = cut.collect()
    wanted = [(i, t, *brute_cut(i, t, how)) for i, t, _ in CUT_ROWS]
    got = [(r.doc_id, r.text, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in rows]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert all(r.restored == (r.text or "") for r in rows)
    assert len({r.form for r in rows}) == 3
    assert fill_middle(docs.limit(0), how).count() == 0
    assert not re.search("PythonUDF|MapIn|ArrowEval|Exchange", plan(cut))


def test_markers_that_could_be_mistaken():
    for markers in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "x"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            FillMiddle(*markers)


# --- archives ----------------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "<p>one</p>", "r"), (2, "http://a/\r\n2", "<p>one</p>", "r"), (3, None, None, "r"), (4, "http://é/4", "", "r"),
    (5, "http://a/5", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n\r\n", "r"), (2, "http://a/2", "<p>one</p>", "r"),
    (1, "http://a/1", "<p>one</p>", "r"), (None, "http://a/0", "<p>one</p>", "r"), (None, None, "<p>alone é漢</p>", "r"),
    (6, "http://a/6", "y" * 3_000_000, "r"), (7, "http://a/7", "".join(map(chr, random.Random(1).choices(range(32, 900), k=200_000))), "r"),
    *((100 + k, f"http://b/{k}", "copy" if k % 3 == 0 else f"page {k}", "r") for k in range(200)),
]


def brute_records(pages, revisit_from=0):
    payloads = [(i, (h or "").encode()) for i, _, h, _ in pages]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= revisit_from:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        to = first.get(p)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, *(("response", None) if to is None or i == to else ("revisit", to))))
    return Counter(out)


@pytest.mark.parametrize("revisit_from", [0, 10])
def test_archives_give_the_pages_back(spark, tmp_path, revisit_from):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string").repartition(3)
    judged = warc.judged_pages(pages, revisit_from=revisit_from)
    archives = warc.write_archives(judged, f"{tmp_path}/whole", archive_bytes=1_000_000)
    assert archives.count() > 3
    index = warc.normalise_archives(archives, f"{tmp_path}/members")
    records = warc.read_archives(index, range_bytes=2_000)
    got = records.select(
        warc.page_number("record_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to")
    ).collect()
    assert Counter(map(tuple, got)) == brute_records(PAGES, revisit_from)
    texts = Counter(bytes(r.payload) for r in records.filter("record_type = 'response'").collect())
    assert set(texts) == {(h or "").encode() for _, _, h, _ in PAGES}
    # each index row is a gzip member of its own, which holds just its record
    for r in index.limit(40).collect():
        with open(r.archive, "rb") as file:
            file.seek(r.offset)
            record = gzip.decompress(file.read(r.length))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert f"<{r.record_id}>".encode() in record and record.count(b"WARC-Record-ID: ") == 1
    assert all(len(open(r.archive, "rb").read()) == r.bytes for r in archives.collect())


def test_empty_table_and_columns(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(warc.judged_pages(none), f"{tmp_path}/whole")
    index = warc.normalise_archives(archives, f"{tmp_path}/members")
    assert archives.count() == 0 and index.count() == 0 and warc.read_archives(index).count() == 0


def whole_stream(records: list[bytes], members: int) -> bytes:
    """Records in so many gzip members, cut anywhere."""
    raw = b"".join(records)
    step = max(1, len(raw) // members)
    return b"".join(gzip.compress(raw[k : k + step]) for k in range(0, len(raw), step))


@pytest.mark.parametrize("members", [1, 2, 7])
def test_streams_of_others(monkeypatch, members):
    """Other record types, folded headers, line ends as padding, members that end inside records."""
    monkeypatch.setattr(warc, "BLOCK", 37)
    body = bytes(random.Random(2).randbytes(5000)) + b"\r\n\r\nWARC/1.1\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nSoftware: a\r\n  b\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    data = b"WARC/1.0\r\nwarc-type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n\r\n\r\n"
    source, out = io.BytesIO(whole_stream([info, data, info], members)), io.BytesIO()
    index = list(warc.normalise_stream(warc._blocks(source), out.write))
    assert [f["warc-type"] for _, _, f in index] == ["warcinfo", "resource", "warcinfo"]
    assert index[0][2]["software"] == "a b"
    got = [gzip.decompress(out.getvalue()[o : o + n]) for o, n, _ in index]
    assert got == [info, data[:-4], info]


def test_broken_streams():
    record = warc.record_bytes("urn:page:1", "response", "u", None, warc.base32_digest(b"x"), 1, b"x", "d")
    whole = gzip.compress(record)
    for broken in (whole[:-12], gzip.compress(record[:-8]), gzip.compress(record[:30]), gzip.compress(b"nonsense\r\n\r\n")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.normalise_stream(iter([broken]), lambda data: None))
    _, fields, block = next(warc.records_of(iter([record])))
    with pytest.raises(ValueError):
        warc.read_record(fields, b"".join(block) + b"y")


def test_lost_attempts_leave_nothing(spark, tmp_path):
    """Files that no table names are not read, and are not in the way."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string")
    archives = warc.write_archives(warc.judged_pages(pages), f"{tmp_path}/whole")
    (tmp_path / "whole" / "pages-lost.warc.gz").write_bytes(b"half of a stream")
    records = warc.read_archives(warc.normalise_archives(archives, f"{tmp_path}/members"))
    assert records.count() == len(PAGES)


def test_whole_table(spark, sf_dir):
    assert op12_warc(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


# --- clusters ----------------------------------------------------------------------------


def vector_rows() -> list[tuple]:
    rnd = random.Random(4)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(4)], 1) for k in range(200)]
    rows += [(7, rows[7][1], 1)] * 300  # one row, very often
    rows += [(500 + k, [0.5, 0.5, -0.5, 0.25], 1) for k in range(40)]  # ties
    rows += [(8, [float(k), 0.0, 0.0, 0.0], 1) for k in range(5)]  # one id, other vectors
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 3, 1), (903, [1.0, None, 1.0, 1.0], 1)]
    rows += [(904, [1.0, float("nan"), 1.0, 1.0], 1), (905, [float("inf"), 1.0, 1.0, 1.0], 1), (906, [3e38, 1.0, 1.0, 1.0], 1)]
    rows += [(None, [0.1, 0.2, 0.3, 0.4], 1), (907, [-0.0, 1e-9, -1e-9, 0.0], 1)]
    return rows


def brute_clusters(rows, k, rounds):
    import math
    import struct

    kept = []
    for i, v, _ in rows:
        if v is None or len(v) != 4 or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [struct.unpack("f", struct.pack("f", x))[0] for x in v]
        if all(abs(math.floor(256 * x)) < 2**27 for x in v):
            kept.append((i, tuple(math.floor(256 * x) for x in v)))
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [
            tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else c for j, c in enumerate(centroids)
        ]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    total = Counter()
    for _, j, d in found:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values())) for i, j, d in found), centroids


@pytest.mark.parametrize("k, rounds", [(6, 3), (300, 2), (1, 1)])
def test_clusters(spark, k, rounds):
    rows = vector_rows()
    # the last column has the name of one that is added
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").repartition(5)
    assigned, centroids = cluster_vectors(vectors, k, rounds, dims=4)
    assert not re.search("PythonUDF|MapIn|ArrowEval", plan(assigned))
    done = with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia")
    wanted, means = brute_clusters(rows, k, rounds)
    assert centroids == means and Counter(map(tuple, done.collect())) == wanted


def test_first_centroids_when_the_bound_is_too_low(spark):
    """Digests that lie above the first bound: it is raised until enough vectors meet it."""
    rows = [(k, [k / 256] * 4, 1) for k in range(3000)]
    rows = sorted(rows, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[500:]
    whole = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), dims=4)
    assert first_centroids(whole, len(rows), 10) == [(r[0],) * 4 for r in rows[:10]]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assigned, centroids = cluster_vectors(none)
    assert centroids == [] and with_inertia(assigned, centroids).count() == 0


def test_all_vectors(spark, sf_dir):
    assert op13_centroids(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
