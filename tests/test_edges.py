"""Edges: events without a batch, tables not written yet, numbers too long to be numbers."""

from __future__ import annotations

import pytest

from trailspark.operators.admission import admitted_events, batch_decisions
from trailspark.operators.filters import EventFilter
from trailspark.sinks.dead_letters import read_dead_letters
from trailspark.sinks.ledger import ledger_totals, read_ledger
from trailspark.sources.events import read_events, read_rollup


def test_a_refused_batch_without_a_name_is_refused(spark, table):
    columns = [c for c in table.columns if c not in ("batch", "position")]
    events = table.select(*columns).limit(4).selectExpr(
        "*", "CAST(NULL AS STRING) AS batch", "monotonically_increasing_id() AS position"
    )
    broken = events.selectExpr(*[c for c in events.columns if c != "actor"], "CAST(NULL AS STRING) AS actor")
    refused = batch_decisions(broken, "batch", "position").filter("reason IS NOT NULL")
    assert refused.count() == 1
    assert admitted_events(broken, "batch", "position").count() == 0


def test_tables_before_the_first_batch_are_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    for read in (read_events, read_rollup, read_dead_letters, read_ledger):
        assert read(spark, path).count() == 0
    assert {r.events for r in ledger_totals(read_ledger(spark, path)).collect()} == {0}


@pytest.mark.parametrize(
    "text, number",
    [("1" * 5000, 0), ("0" * 5000 + "7", 7), ("-9223372036854775808", -(2**63)), ("9223372036854775808", 0), ("+20", 20), ("2x", 0)],
)
def test_numbers(text, number):
    assert EventFilter.from_params({"limit": [text]}).limit == number
