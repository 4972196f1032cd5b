"""Where messages come from: line numbers, and what has been read of each source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailspark.sinks.ranges import not_read_by_others, read_ranges, write_ranges
from trailspark.sources.envelopes import read_envelopes
from trailspark.sources.events import read_events
from trailspark.sources.messages import from_text, stream_files, stream_text
from trailspark.streaming.ingest import IngestTables, start_ingest


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Two files of lines of uneven length, some empty, one without an end of line."""
    folder = tmp_path_factory.mktemp("lines")
    texts = {"a.txt": [f'{{"actor":"{k}"}}' + "x" * (k % 37 * 10) for k in range(4000)] + ["last"], "b.txt": ["", "one", "", "two"] * 500}
    for name, rows in texts.items():
        (folder / name).write_text("\n".join(rows))
    return str(folder), {name: rows for name, rows in texts.items()}


@pytest.mark.parametrize("split", ["1g", "20k", "3k"])
def test_line_numbers_do_not_depend_on_splits(spark, lines, split):
    path, texts = lines
    wanted = sorted((name, k, row) for name, rows in texts.items() for k, row in enumerate(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        messages = from_text(spark, path)
        got = [(r["source"].rsplit("/", 1)[1], r["position"], r["body"]) for r in messages.collect()]
        documents = read_envelopes(spark, path)
        rows = [(r["source_file"].rsplit("/", 1)[1], r["source_row"], r["body"]) for r in documents.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(rows) == wanted
    assert from_text(spark, path, numbered=False).filter("position IS NOT NULL").count() == 0


def tables_in(root) -> IngestTables:
    return IngestTables(f"{root}/events", f"{root}/dead", f"{root}/ledger", ranges=f"{root}/ranges")


@pytest.mark.parametrize("split", ["1g", "3k"])
def test_ids_of_streamed_lines_do_not_depend_on_splits(spark, lines, tmp_path, split):
    path, texts = lines
    tables = tables_in(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        start_ingest(stream_text(spark, path), tables, f"{tmp_path}/c", available_now=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    stored = read_events(spark, tables.events)
    found = {(r["actor"], r["id"]) for r in stored.select("actor", "id").collect()}
    test_ids_of_streamed_lines_do_not_depend_on_splits.seen.append(found)
    seen = test_ids_of_streamed_lines_do_not_depend_on_splits.seen
    assert len(found) == 4000 // 37 + 1 and all(s == seen[0] for s in seen)


test_ids_of_streamed_lines_do_not_depend_on_splits.seen = []


def test_a_source_is_stored_once_whoever_reads_it(spark, tmp_path):
    """A second stream over the same files adds only the files that the first has not read."""
    (tmp_path / "in").mkdir()
    tables = tables_in(tmp_path)
    event = '{"actor":"%s","action":"a.b","target_type":"t","scope_type":"s"}'

    def arrive(name, *actors):
        (tmp_path / "in" / name).write_text("".join(event % a + "\n" for a in actors))

    def ingest(query, after_batch=None):
        start_ingest(
            stream_text(spark, f"{tmp_path}/in"), tables, f"{tmp_path}/{query}", query=query, available_now=True,
            after_batch=after_batch,
        ).awaitTermination()

    def lose(batch_id):
        raise RuntimeError("lost")

    def actors():
        return sorted(r["actor"] for r in read_events(spark, tables.events).collect())

    arrive("a", "a1", "a2")
    with pytest.raises(Exception, match="lost"):
        ingest("first", lose)
    ingest("first")
    assert actors() == ["a1", "a2"]
    ingest("second")
    assert actors() == ["a1", "a2"]
    arrive("b", "b1", "b1")
    ingest("second")
    ingest("first")
    ingest("third")
    assert actors() == ["a1", "a2", "b1", "b1"]


def test_runs_of_positions(spark, tmp_path):
    path = str(tmp_path / "ranges")

    def records(*places):
        return spark.createDataFrame(places, "source string, position bigint")

    everything = records(*(("t/0", k) for k in range(30)), *(("t/1", k) for k in range(5)))
    assert not_read_by_others(everything, path, query="q").count() == 35
    for batch, (first, last) in enumerate([(0, 4), (5, 9), (20, 24)]):
        write_ranges(records(*(("t/0", k) for k in range(first, last + 1))), path, f"p-{batch}", query="p")
    assert sorted(tuple(r) for r in read_ranges(spark, path).select("source", "first", "last").collect()) == [
        ("t/0", 0, 9), ("t/0", 20, 24),
    ]
    left = not_read_by_others(everything, path, query="q").filter("source = 't/0'")
    assert sorted(r["position"] for r in left.collect()) == [*range(10, 20), *range(25, 30)]
    assert not_read_by_others(everything, path, query="p").count() == 35
    # a batch that is written again replaces its runs
    write_ranges(records(("t/0", 20)), path, "p-2", query="p")
    assert read_ranges(spark, path).agg(F.max("last")).first()[0] == 20


def test_delivery_files_have_places_of_their_own(spark, sf_dir, tmp_path):
    from trailspark.plans.catalog import delivery_files

    source = delivery_files(spark, sf_dir)
    tables = tables_in(tmp_path)
    for query in ("one", "two"):
        start_ingest(stream_files(spark, source), tables, f"{tmp_path}/{query}", query=query, available_now=True).awaitTermination()
        n = read_events(spark, tables.events).count()
    assert n == read_events(spark, tables.events).select("id").distinct().count() > 0
    assert read_events(spark, tables.events).filter("batch LIKE 'two%'").count() == 0
