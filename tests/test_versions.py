"""The change log against a model kept in dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import branches, versions

LOG = "id bigint, ts bigint, seq int, op string, value int"


@pytest.fixture(scope="module")
def model():
    r, rows, states, live = random.Random(11), [], {0: {}}, {}
    for ts in range(1, 121):
        for seq, i in enumerate(r.sample(range(20), r.randint(1, 3))):
            if i in live and r.random() < 0.32:
                rows.append((i, ts, seq, "delete", None))
                live.pop(i)
            else:
                rows.append((i, ts, seq, "upsert", r.randrange(1000)))
                live[i] = rows[-1][4]
        states[ts] = dict(live)
    return rows, states


@pytest.fixture(scope="module")
def log(spark, model):
    return spark.createDataFrame(model[0], LOG).cache()


def view(frame):
    return {r.id: r.value for r in frame.select("id", "value").collect()}


@pytest.mark.parametrize("t", [0, 1, 37, 120, 999])
def test_snapshots(log, model, t):
    want = model[1][min(t, 120)]
    assert view(versions.as_of(versions.intervals(log), t)) == want
    assert view(versions.latest(log, t)) == want


def test_intervals_never_overlap(log):
    spans = {}
    for r in versions.intervals(log).orderBy("id", "begin_ts").collect():
        if r.id in spans:
            assert spans[r.id] is not None and spans[r.id] <= r.begin_ts
        spans[r.id] = r.end_ts


def test_a_version_replaced_in_its_commit_is_never_seen(spark):
    rows = spark.createDataFrame([(1, 5, 0, "upsert", 1), (1, 5, 1, "upsert", 2)], LOG)
    assert [(r.value, r.begin_ts) for r in versions.intervals(rows).collect()] == [(2, 5)]


@pytest.mark.parametrize(("oldest", "budget", "readers"), [(60, 0, ()), (60, 5, ()), (60, 0, (30,)), (0, 0, ())])
def test_vacuum(log, model, oldest, budget, readers):
    own = versions.intervals(log)
    every = {(r.id, r.begin_ts, r.end_ts) for r in own.collect()}
    horizon = min([oldest, *readers])
    ended = sorted((e, b, i) for i, b, e in every if e is not None and e < horizon)
    gone = {(i, b, e) for e, b, i in (ended[:budget] if budget else ended)}
    assert {(r.id, r.begin_ts, r.end_ts) for r in versions.reclaimable(own, oldest, budget, readers).collect()} == gone
    kept = versions.vacuumed(own, oldest, budget, readers)
    assert {(r.id, r.begin_ts, r.end_ts) for r in kept.collect()} == every - gone
    for t in (horizon, 90, 120):
        assert view(versions.as_of(kept, t)) == model[1][t]


def test_pruned_history_answers_later_reads(log):
    history = log.where("op = 'upsert'").withColumnRenamed("ts", "stamp")
    kept = versions.pruned(history, 60)
    for t in (60, 61, 100):
        a, b = (view(versions.value_as_of(h, t, ["value"], earliest=False)) for h in (history, kept))
        assert a == b
    assert kept.count() < history.count()


def test_value_as_of_falls_back_to_the_earliest(spark):
    rows = spark.createDataFrame([(1, 5, 0, "a"), (1, 9, 0, "b"), (2, 7, 0, "c")], "id int, stamp int, seq int, v string")
    get = lambda t, e: {r.id: r.v for r in versions.value_as_of(rows, t, ["v"], e).collect()}
    assert get(6, True) == {1: "a", 2: "c"} and get(6, False) == {1: "a"} and get(9, True) == {1: "b", 2: "c"}


def test_carried_forward(spark):
    rows = spark.createDataFrame([(1, 1, 0, "upsert", 5), (1, 2, 0, "upsert", None), (1, 3, 0, "delete", None), (1, 4, 0, "upsert", None), (1, 5, 0, "upsert", 6), (1, 6, 0, "upsert", None)], LOG)
    got = [r.value for r in versions.carried_forward(rows, ["value"]).where("op = 'upsert'").orderBy("ts").collect()]
    assert got == [5, 5, None, 6, 6]


def test_stats_and_clock(log, model):
    row = versions.stats(versions.intervals(log), 120).first()
    assert row.live == len(model[1][120]) and row.clock == 120
    assert versions.clock(log).first().clock == 120 and versions.clock(log.limit(0)).first().clock == 0


def test_merged_metadata(spark):
    rows = spark.createDataFrame([(1, 1, 0, {"a": "1", "b": "1"}), (1, 2, 0, {"b": "2"}), (1, 2, 1, {"c": "3"})], "id int, ts int, seq int, metadata map<string,string>")
    assert versions.merged_metadata(rows).first().metadata == {"a": "1", "b": "2", "c": "3"}


def test_random_branches(spark, log, model):
    """80 random operations on a branch against a dictionary, read after every 20."""
    r, fork = random.Random(113), 50
    base = versions.latest(log, fork).select("id", "value")
    mine, delta = dict(model[1][fork]), []
    for seq in range(80):
        if mine and r.random() < 0.32:
            i = r.choice(sorted(mine))
            delta.append((i, seq, "delete", None))
            mine.pop(i)
        else:
            i = r.randrange(20)
            delta.append((i, seq, "upsert", r.randrange(1000)))
            mine[i] = delta[-1][3]
        if seq % 20 == 19:
            frame = spark.createDataFrame(delta, "id bigint, seq int, op string, value int")
            assert view(branches.overlay(base, frame)) == mine
    touched = {d[0] for d in delta}
    moved = {row[0] for row in model[0] if row[1] > fork}
    assert {x.id for x in branches.conflicts(log, frame, fork).collect()} == touched & moved
    with pytest.raises(ValueError, match="conflicts"):
        branches.merged(log, frame, fork, 121, branches.FAIL)
    after = view(versions.latest(branches.merged(log, frame, fork, 121)))
    want = {i: v for i, v in model[1][120].items() if i not in touched} | {i: v for i, v in mine.items() if i in touched}
    assert after == want


def test_profile_and_diff(log, model):
    paged = versions.as_of(versions.intervals(log), 120).withColumn("page_id", F.col("id") % 3)
    rows = versions.page_profile(paged, F.col("value") > 500).collect()
    assert sum(x.live for x in rows) == len(model[1][120])
    changes = {r.id: r.change for r in versions.snapshot_diff(versions.intervals(log), 40, 120).collect()}
    assert {i for i, c in changes.items() if c == "added"} == set(model[1][120]) - set(model[1][40])
