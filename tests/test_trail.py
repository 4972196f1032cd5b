"""One trail over landed and compacted events: commits, look-up index, layouts."""

from __future__ import annotations

import os
import random
from datetime import date, datetime, timezone
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.plans import plan, scan_part
from trailspark.operators.filters import EventFilter, filter_events
from trailspark.operators.groups import group_events, merge_groups, write_rollup
from trailspark.operators.listing import fetch_page
from trailspark.plans.audit_view import table_events
from trailspark.schema import GROUP_SCHEMA, STORED_COLUMNS
from trailspark.sinks.events import append_events, write_days
from trailspark.sinks.layout import bounds, by_lookup, by_time, interleave, rank
from trailspark.sinks.trail import compact_rollup, compact_trail, remove_superseded, superseded
from trailspark.sources.events import read_events
from trailspark.sources.lookups import LOOKUP_COLUMNS, files_with
from trailspark.sources.trail import ROLLUP, TrailTables, landed_rows, read_snapshot, read_trail
from trailspark.streaming.ingest import batch_key

DAY = date(2024, 1, 10)


def tables_in(root) -> TrailTables:
    return TrailTables(*(f"{root}/{name}" for name in ("landed", "compacted", "commits", "lookups")))


def ids(df) -> list[str]:
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    """Three days of events in parts of a third."""
    rows = table_events(spark, sf_dir).select(*STORED_COLUMNS)
    rows = rows.filter("to_date(created_at) BETWEEN DATE'2024-01-09' AND DATE'2024-01-11'")
    return rows.withColumn("part", F.pmod(F.hash("id"), F.lit(3))).cache()


def land(events, tables, n: int) -> None:
    append_events(events.filter(F.col("part") == n).drop("part"), tables.landed, batch_key("ingest", n))


def test_late_events_of_a_compacted_day_belong_to_the_trail(spark, events, tmp_path):
    tables = tables_in(tmp_path)
    assert read_trail(spark, tables).count() == 0 and compact_trail(spark, tables) is None
    land(events, tables, 0)
    assert ids(read_trail(spark, tables)) == ids(events.filter("part = 0"))
    assert compact_trail(spark, tables, DAY, DAY) == 1
    assert ids(read_trail(spark, tables)) == ids(events.filter("part = 0"))
    land(events, tables, 1)
    land(events, tables, 0)  # a batch that is written again after it was compacted
    assert ids(read_trail(spark, tables)) == ids(events.filter("part < 2"))
    assert compact_trail(spark, tables) == 2
    assert compact_trail(spark, tables) is None
    land(events, tables, 2)
    assert ids(read_trail(spark, tables)) == ids(events)
    day = events.filter(F.to_date("created_at") == F.lit(DAY))
    assert ids(read_trail(spark, tables, DAY, DAY)) == ids(day)
    snapshot = read_snapshot(spark, tables)
    assert ids(landed_rows(spark, tables, snapshot)) == ids(events.filter("part = 2"))


def test_a_reader_sees_the_state_it_began_with(spark, events, tmp_path):
    tables = tables_in(tmp_path)
    land(events, tables, 0)
    compact_trail(spark, tables)
    land(events, tables, 1)
    early = read_trail(spark, tables)
    before = ids(early)
    compact_trail(spark, tables)
    land(events, tables, 2)
    assert ids(early) == before == ids(events.filter("part < 2"))
    # the state of the first commit, over what has landed by now
    assert ids(read_trail(spark, tables, as_of=1)) == ids(events)
    assert ids(read_trail(spark, tables, as_of=0)) == ids(events)


def test_what_a_lost_compaction_wrote_is_not_read(spark, events, tmp_path, monkeypatch):
    tables = tables_in(tmp_path)
    land(events, tables, 0)

    def lose(*args, **kwargs):
        raise RuntimeError("lost")

    for step in ("write_lookups", "_commit"):
        with monkeypatch.context() as patched:
            patched.setattr(f"trailspark.sinks.trail.{step}", lose)
            with pytest.raises(RuntimeError, match="lost"):
                compact_trail(spark, tables)
        assert ids(read_trail(spark, tables)) == ids(events.filter("part = 0"))
    assert read_events(spark, tables.compacted).count() == 2 * events.filter("part = 0").count()
    assert compact_trail(spark, tables) == 1
    assert ids(read_trail(spark, tables)) == ids(events.filter("part = 0"))


def test_of_two_compactions_at_a_time_one_fails(spark, events, tmp_path, monkeypatch):
    tables = tables_in(tmp_path)
    land(events, tables, 0)
    import trailspark.sinks.trail as trail

    plain, nested = trail.write_lookups, []

    def meanwhile(*args):
        if not nested:
            nested.append(True)
            compact_trail(spark, tables)
        plain(*args)

    monkeypatch.setattr(trail, "write_lookups", meanwhile)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        compact_trail(spark, tables)
    assert ids(read_trail(spark, tables)) == ids(events.filter("part = 0"))


def test_folders_that_do_not_count_are_not_opened(spark, events, tmp_path):
    tables = tables_in(tmp_path)
    land(events, tables, 0)
    compact_trail(spark, tables)
    land(events, tables, 1)
    compact_trail(spark, tables, DAY, DAY)
    trail = read_trail(spark, tables, DAY, DAY)
    scans = [line for line in scan_part(trail, "PartitionFilters").splitlines() if "batch" in line]
    assert len(scans) == 2
    ids(trail)
    # every file that is read is of the day and of its last version
    files = {os.path.relpath(r[0].removeprefix("file://"), tmp_path) for r in trail.select(F.input_file_name()).distinct().collect()}
    version = read_snapshot(spark, tables).versions()[DAY]
    assert {str(Path(f).parent) for f in files} == {f"compacted/created_date={DAY}/batch={version}"}


def test_superseded_folders(spark, events, tmp_path):
    tables = tables_in(tmp_path)
    for n in range(3):
        land(events, tables, n)
        assert superseded(spark, tables) == [] or n == 2
        compact_trail(spark, tables)
    gone = remove_superseded(spark, tables)
    # commit 3 counts and commit 2 is kept: what only commit 1 or nobody reads goes
    batches = {Path(f).name for f in gone if "/landed/" in f}
    assert batches == {f"batch={batch_key('ingest', n)}" for n in (0, 1)}
    assert {Path(f).name[:15] for f in gone if "/compacted/" in f} == {"batch=v00000001"}
    assert not any(os.path.exists(f) for f in gone)
    assert ids(read_trail(spark, tables)) == ids(read_trail(spark, tables, as_of=2)) == ids(events)


def test_a_day_is_written_again_when_it_has_grown(spark, events, tmp_path):
    """With versions that double, 24 batches rewrite a row a few times, not 24."""
    tables = tables_in(tmp_path)
    written = []
    day = events.filter(F.to_date("created_at") == F.lit(DAY)).drop("part").cache()
    for n in range(24):
        append_events(day.filter(F.pmod(F.hash("id"), F.lit(24)) == n), tables.landed, batch_key("ingest", n))
        if compact_trail(spark, tables, growth=1.0):
            written.append(read_snapshot(spark, tables).rows[0]["rows"])
    assert ids(read_trail(spark, tables)) == ids(day)
    assert sum(written) < 4 * day.count() and written == sorted(written) and len(written) < 8
    assert all(b >= 2 * a for a, b in zip(written, written[1:]))


def test_rollup_parts_are_merged(spark, events, tmp_path):
    tables = TrailTables(*(f"{tmp_path}/{name}" for name in ("landed", "compacted", "commits")), kind=ROLLUP)
    for n in range(3):
        part = events.filter(F.col("part") == n).drop("part")
        write_rollup(group_events(part), tables.landed, batch_key("ingest", n))
        if n == 1:
            assert compact_rollup(spark, tables, DAY, DAY) == 1
    assert compact_rollup(spark, tables) == 2 and compact_rollup(spark, tables) is None
    whole = read_trail(spark, tables).select(*GROUP_SCHEMA.names)
    wanted = group_events(events.drop("part"))
    assert whole.exceptAll(wanted).count() == wanted.exceptAll(whole).count() == 0  # merged already
    write_rollup(group_events(events.filter("part = 0").drop("part")), tables.landed, batch_key("ingest", 3))
    assert merge_groups(read_trail(spark, tables)).agg(F.sum("count")).first()[0] == events.count() + events.filter("part = 0").count()
    folders = remove_superseded(spark, tables)
    assert folders and merge_groups(read_trail(spark, tables)).count() == wanted.count()


# --- look-ups ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """200 requests over 20 days, each in few files, and one actor in all of them."""
    tables = tables_in(tmp_path_factory.mktemp("spread"))
    n = F.col("id")
    text = {c: F.lit("x") for c in STORED_COLUMNS if c not in ("id", "created_at")}
    rows = spark.range(4000).withColumns(
        text
        | {
            "request_id": F.concat(F.lit("r"), (F.floor(n / 20)).cast("string")),
            "target_id": F.when(n % 97 == 0, None).otherwise(F.concat(F.lit("t"), (n % 1000).cast("string"))),
            "created_at": F.timestamp_seconds(F.lit(1704067200) + F.floor(n / 200) * 86400 + n % 86400),
            "id": n.cast("string"),
        }
    )
    append_events(rows.select(*STORED_COLUMNS), tables.landed, "load")
    compact_trail(spark, tables)
    return tables


def test_files_of_a_value_are_never_left_out(spark, spread):
    rows = read_events(spark, spread.compacted).withColumn("file", F.col("_metadata.file_path")).collect()
    versions = read_snapshot(spark, spread).versions()
    rnd = random.Random(1)
    for column in LOOKUP_COLUMNS:
        values = sorted({r[column] for r in rows if r[column] is not None})
        for value in rnd.sample(values, min(3, len(values))) + ["not there"]:
            holds = {r["file"] for r in rows if r[column] == value}
            named = files_with(spark, spread.lookups, versions, column, value)
            assert holds <= set(named) and len(named) <= len(holds) + 2
    with pytest.raises(ValueError):
        files_with(spark, spread.lookups, versions, "client_ip", "x")


def test_a_lookup_opens_the_files_it_needs(spark, spread):
    flt = EventFilter(request_id="r77")
    found = filter_events(read_trail(spark, spread, lookup=("request_id", "r77")), flt)
    assert ids(found) == sorted(str(k) for k in range(77 * 20, 78 * 20))
    opened = [sum("/compacted/" in f for f in df.inputFiles()) for df in (found, read_trail(spark, spread))]
    assert 1 <= opened[0] < opened[1] / 5
    assert ids(filter_events(read_trail(spark, spread, lookup=("request_id", "none")), EventFilter(request_id="none"))) == []
    page = fetch_page(read_trail(spark, spread, lookup=("request_id", "r77")), flt, newest=datetime(2024, 2, 1, tzinfo=timezone.utc))
    assert len(page.events) == 20


# --- layouts -----------------------------------------------------------------------------


def test_ranks_and_places(spark):
    rnd = random.Random(2)
    values = ["a"] * 500 + [f"k{rnd.randint(0, 999):03d}" for _ in range(2000)] + ["", "z"]
    ordered = bounds(values)
    assert ordered == sorted(set(ordered)) and len(ordered) < 64 and bounds([]) == []
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for r in rows.select("v", rank(F.col("v"), ordered).alias("r")).collect():
        assert r["r"] == sum(b <= r["v"] for b in ordered)
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int")
    for r in pairs.select("a", "b", interleave([F.col("a"), F.col("b")], 3).alias("z")).collect():
        assert f"{r['z']:06b}" == "".join(x + y for x, y in zip(f"{r['a']:03b}", f"{r['b']:03b}"))


def groups_to_read(path, tests: dict[str, str]) -> float:
    """Share of the row groups whose least and greatest values allow all of these values."""
    hit = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(k).name for k in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            total += 1
            stats = {n: meta.row_group(g).column(names.index(n)).statistics for n in tests}
            hit += all(stats[n].min <= v <= stats[n].max for n, v in tests.items())
    return hit / total


def test_lookups_read_few_row_groups(spark, tmp_path):
    n = F.col("id")
    h = lambda salt, m: F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(m)).cast("string")
    text = {c: F.sha2(F.concat(n, F.lit(c)), 256) for c in STORED_COLUMNS if c not in ("id", "created_at")}
    rows = spark.range(0, 60_000, 1, 4).withColumns(
        text
        | {
            "scope_type": F.lit("tenant"), "scope_id": F.concat(F.lit("s"), h(1, 40)), "service": F.concat(F.lit("svc"), h(2, 20)),
            "actor": F.concat(F.lit("u"), h(3, 500)), "target_type": F.lit("order"), "target_id": F.concat(F.lit("t"), h(4, 900)),
            "created_at": F.timestamp_seconds(F.lit(1704067200) + n % 86400), "id": n.cast("string"),
            "http_status": F.lit(200), "created_date": F.lit(date(2024, 1, 1)), "batch": F.lit("b"),
        }
    )
    share = {}
    small = {"parquet.block.size": str(256 << 10), "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"}
    for layout in (by_time, by_lookup):
        path = f"{tmp_path}/{layout.__name__}"
        write_days(layout(rows), path, small)
        assert ids(read_events(spark, path)) == ids(rows)
        asked = {"scope": {"scope_id": "s17"}, "service": {"service": "svc7"}, "actor": {"actor": "u77"}, "target": {"target_id": "t77"}}
        share[layout.__name__] = {k: groups_to_read(path, v) for k, v in asked.items()}
    print(share)
    for name, part in share["by_lookup"].items():
        assert part < 0.6 * share["by_time"][name], (name, share)
    both = groups_to_read(f"{tmp_path}/by_lookup", {"scope_id": "s17", "service": "svc7"})
    assert both < 0.25
    assert "PythonUDF" not in plan(by_lookup(rows))
