"""Ordered operators against plain Python, with groups whole and cut into pieces."""

import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from shipflow.operators import flow, sequence

ORDER = ("event_sequence", "event_timestamp", "event_id")
SCHEMA = (
    "shipment_id string, event_sequence int, event_timestamp timestamp, event_id string, "
    "event_status string, current_hub_id string"
)


def sample(seed=7, hot=600, others=40):
    """A third and more of the rows in one shipment, equal sequences and times, some null sequences."""
    draw = random.Random(seed)
    rows = []
    for i in range(hot + others * 5):
        shipment = "HOT" if i < hot else f"S{i % others}"
        sequence_number = None if draw.random() < 0.02 else draw.randint(1, 3)
        rows.append(
            (shipment, sequence_number, at(draw.randint(0, 20)), f"E{i:05d}", draw.choice("ABC"), draw.choice("XYZ") if draw.random() > 0.05 else None)
        )
    draw.shuffle(rows)
    return rows


def in_order(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(6)


LIMITS = [{}, {"max_rows": 40}, {"max_rows": 4}]


@pytest.mark.parametrize("limits", LIMITS)
def test_stage_transitions(events, limits):
    got = {row.event_id: row.from_status for row in flow.stage_transitions(events, **limits).collect()}
    want = {}
    for group in in_order(sample()).values():
        for before, row in zip([None, *group], group):
            want[row[3]] = before and before[4]
    assert got == want


@pytest.mark.parametrize("limits", LIMITS)
def test_hub_path(events, limits):
    got = sorted((r.shipment_id, r.hop_number, r.hub_id) for r in flow.hub_path(events, **limits).collect())
    want = []
    for shipment, group in in_order(sample()).items():
        path = []
        for row in group:
            if row[5] is not None and (not path or path[-1] != row[5]):
                path.append(row[5])
        want += [(shipment, number, hub) for number, hub in enumerate(path, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("limits", LIMITS)
def test_sequence_anomalies(events, limits):
    got = {
        r.event_id: (r.time_goes_back, r.missing_steps)
        for r in flow.sequence_anomalies(events, **limits).collect()
    }
    want = {}
    for group in in_order(sample()).values():
        for before, row in zip([None, *group], group):
            back = before is not None and row[2] < before[2]
            previous = (before and before[1]) or 0
            missing = 0 if row[1] is None else max(row[1] - previous - 1, 0)
            if back or missing > 0:
                want[row[3]] = (back, missing)
    assert got == want


def test_hot_group_is_split_and_pieces_are_in_order(events):
    groups = sequence.cut_groups(events, "shipment_id", ORDER, max_rows=40)
    pieces = groups.rows.filter("shipment_id = 'HOT'").groupBy(sequence.PIECE).agg(
        F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("low"), F.max(F.struct(*ORDER)).alias("high")
    ).orderBy(sequence.PIECE).collect()
    assert len(pieces) > 20 and max(p.n for p in pieces) < 120
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert all(key(a.high) < key(b.low) for a, b in zip(pieces, pieces[1:]))
    whole = groups.rows.filter("shipment_id <> 'HOT'").select(sequence.PIECE).distinct().collect()
    assert [row[0] for row in whole] == [None]


def test_without_large_groups_the_plan_is_one_window(events):
    frame = flow.stage_transitions(events)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(shipment_id") == 1


def test_pivots_too_many_to_broadcast_are_joined(events, monkeypatch):
    want = sorted(flow.stage_transitions(events).collect())
    monkeypatch.setattr(sequence, "BROADCAST_PIVOTS", 0)
    assert sorted(flow.stage_transitions(events, max_rows=10).collect()) == want


def test_current_status_is_the_last_in_order(events):
    got = {row.shipment_id: row.current_status for row in flow.current_status(events).collect()}
    assert got == {shipment: group[-1][4] for shipment, group in in_order(sample()).items()}


def test_tied_rows_are_cut_and_rows_without_a_key_left_out(spark):
    rows = [("T", 1, at(0), "E", "A", f"H{i}") for i in range(400)] + [(None, 1, at(0), f"N{i}", "A", "H") for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    groups = sequence.cut_groups(frame, "shipment_id", ORDER, max_rows=40)
    assert groups.rows.count() == 400
    assert groups.rows.select(*groups.unit).distinct().count() > 4
    stepped = sequence.with_position(groups, "n").rows
    assert sorted(row.n for row in stepped.select("n").collect()) == list(range(1, 401))
