import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import orphans

LIFE = "space string, scope string, part string, item string, valid_from timestamp_ntz, valid_to timestamp_ntz"
REF = "space string, scope string, part string, item string, at timestamp_ntz, name string"
BEGIN = dt.datetime(2025, 1, 1)


def at(hours):
    return None if hours is None else BEGIN + dt.timedelta(hours=hours)


def world(seed, n=120):
    rng = random.Random(seed)
    lives, refs = [], []
    for _ in range(n // 3):
        a = rng.randrange(60)
        lives.append(("s", rng.choice(["p", None]), None, rng.choice("abc"), at(a), at(rng.choice([None, a + rng.randrange(-2, 20)]))))
    lives += rng.choices(lives, k=10)
    for i in range(n):
        refs.append(("s", rng.choice(["p", None]), None, rng.choice("abcd"), at(rng.choice([None, *range(70)] if i % 9 == 0 else range(70))), f"r{i}"))
    return lives, refs


def alive(lives, scope, item, t):
    return t is not None and any(x[1] == scope and x[3] == item and x[4] is not None and x[4] <= t and (x[5] is None or t < x[5]) for x in lives)


def events_of(spark, lives, refs):
    return orphans.parent_events(spark.createDataFrame(lives, LIFE)).unionByName(orphans.reference_events(spark.createDataFrame(refs, REF)))


@pytest.mark.parametrize(("seed", "hot_rows", "batches"), [(1, 10**6, 1), (1, 10**6, 4), (2, 5, 3), (3, 1, 2)])
def test_orphans_are_brute_force(spark, seed, hot_rows, batches):
    lives, refs = world(seed)
    moves, got = orphans.in_batches(events_of(spark, lives, refs + refs[:7]), batches, hot_rows)
    want = sorted(r[5] for r in refs if not alive(lives, r[1], r[3], r[4]))
    assert sorted(r.name for r in got.collect()) == want
    assert moves.agg(F.sum("orphaned"), F.sum("arrived")).first()[:] == (sum(1 for r in refs if r[4] and not alive(lives, r[1], r[3], r[4])), sum(1 for r in refs if r[4]))


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_advance_in_any_split_is_one_fold(spark, hot_rows):
    lives, refs = world(5)
    events = events_of(spark, lives, refs).where(F.col("at").isNotNull()).cache()
    _, once, lost = orphans.advance(None, events, hot_rows)
    want, want_lost = sorted(map(tuple, once.collect()), key=str), sorted(map(tuple, lost.collect()), key=str)
    state, got, got_lost = None, [], []
    for lo, hi in ((-9, 20), (20, 41), (41, 999)):
        part = events.where((F.col("at") >= F.lit(at(lo))) & (F.col("at") < F.lit(at(hi))))
        state, moved, orphaned = orphans.advance(state, part, hot_rows)
        got += map(tuple, moved.collect())
        got_lost += map(tuple, orphaned.collect())
        state = spark.createDataFrame(state.collect(), state.schema)
    assert sorted(got, key=str) == want and sorted(got_lost, key=str) == want_lost
    report = {(r.space, r.period): r for r in orphans.by_period(once).collect()}
    timed = [r for r in refs if r[4] is not None]
    assert sum(r.arrived for r in report.values()) == len(timed)
    last = max(r.period for r in report.values())
    dead = sum(1 for r in timed if not alive(lives, r[1], r[3], at(10**4)))
    assert report["s", last].pending == dead


def test_one_moment_holds_all_rows(spark):
    """One key, one moment: the limit is crossed and every reference still comes out once."""
    refs = [("s", "p", None, "gone", at(3), f"r{i}") for i in range(500)] + [("s", "p", None, "there", at(3), f"r{i}") for i in range(500)]
    lives = [("s", "p", None, "there", at(3), at(4)), ("s", "p", None, "gone", at(1), at(3))]
    for batches in (1, 3):
        moves, got = orphans.in_batches(events_of(spark, lives, refs + refs[:90]), batches, 50)
        assert {r.item for r in got.collect()} == {"gone"} and got.count() == 500
        assert {(r.item, r.at): (r.arrived, r.orphaned, r.reopened) for r in moves.collect()} == {("gone", at(3)): (500, 500, 0), ("there", at(3)): (500, 0, 0), ("there", at(4)): (0, 0, 500)}


def test_months_without_events_have_a_row(spark):
    moves = spark.createDataFrame([("s", at(0), 3, 2, 0, 0), ("s", at(24 * 90), 0, 0, 1, 0), ("s", None, 1, 1, 0, 0)], "space string, at timestamp_ntz, arrived int, orphaned int, resolved int, reopened int")
    got = [(r.period, r.arrived, r.pending) for r in orphans.by_period(moves).orderBy("period").collect()]
    assert got == [(None, 1, 1), ("2025-01", 3, 3), ("2025-02", 0, 3), ("2025-03", 0, 3), ("2025-04", 0, 2)]


def test_outputs(spark):
    l1 = spark.createDataFrame(
        [
            ("o1", "p", "v", at(5), None, ([("f1", ["n1", "n2", None, " "]), ("f2", None), (None, ["n3"])], [("f1", "f9"), ("f2", "f1"), (None, ""), ("fx", "f1")])),
            ("o1", "p", "v", at(5), at(9), ([("f1", ["n1", "n2", None, " "]), ("f2", None), (None, ["n3"])], [("f1", "f9"), ("f2", "f1"), (None, ""), ("fx", "f1")])),
            ("o2", "p", "v", at(50), None, ([("f3", [])], None)),
            ("o3", "q", "v", at(50), None, (None, None)),
            ("o4", "q", "w", None, None, None),
        ],
        "output_id string, project_id string, version_id string, produced_at timestamp_ntz, ingested_at timestamp_ntz, l1 struct<features array<struct<feature_id string, source_nodes array<string>>>, feature_relations array<struct<`from` string, `to` string>>>",
    )
    l15 = spark.createDataFrame(
        [("b1", "p", "v", at(6), ([(["f1", "f3", None, ""],), (None,)],)), ("b2", "p", "v", at(60), ([(["f1", "f3"],)],)), ("b3", "p", "none", at(60), ([(["f1"],)],)), ("b4", "p", "v", at(1), ([(["f1"],)],)), ("b5", "p", "v", at(1), None)],
        "output_id string, project_id string, version_id string, produced_at timestamp_ntz, l1_5 struct<blocks array<struct<related_features array<string>>>>",
    )
    nodes = spark.createDataFrame([("p", "n1", at(0), None, "x"), ("p", "n2", at(0), at(5), "x"), ("p", "n3", at(5), None, "x"), ("q", "n2", at(0), None, "x")], "project_id string, node_id string, created_at timestamp_ntz, removed_at timestamp_ntz, scope string")
    got = {tuple(r) for r in orphans.orphan_references(l1, l15, nodes).collect()}
    assert got == {
        ("o1", "to", "f9", "2025-01"), ("o1", "from", "fx", "2025-01"), ("o1", "source_nodes", "n2", "2025-01"), ("b1", "related_features", "f3", "2025-01"),
        ("b2", "related_features", "f1", "2025-01"), ("b3", "related_features", "f1", "2025-01"), ("b4", "related_features", "f1", "2025-01"),
    }
    assert orphans.orphan_references(l1.limit(0), l15.limit(0), nodes.limit(0)).count() == 0
    assert orphans.orphan_report(l1, l15, nodes).where("space = 'source_nodes'").agg(F.sum("arrived")).first()[0] == 3


def test_report_counts_what_is_found(spark):
    def out(name, t, nodes, ends):
        return name, "p", "v", at(t), ([("f1", nodes), (None, None)], ends)

    rows = [out("o1", 5, ["n1", "n2"], [("f1", "f9"), ("fx", "f1"), ("f1", "f9")]), out("o2", None, ["n1"], [("f1", "f8"), (None, "")]), out("o3", 900, ["n2"], None)]
    l1 = spark.createDataFrame(rows + rows[:2], "output_id string, project_id string, version_id string, produced_at timestamp_ntz, l1 struct<features array<struct<feature_id string, source_nodes array<string>>>, feature_relations array<struct<`from` string, `to` string>>>")
    l15 = spark.createDataFrame([("b1", "p", "v", at(6), ([(["f1", "f3"],)],)), ("b2", "p", "v", None, ([(["f1"],)],))], "output_id string, project_id string, version_id string, produced_at timestamp_ntz, l1_5 struct<blocks array<struct<related_features array<string>>>>")
    nodes = spark.createDataFrame([("p", "n1", at(0), None)], "project_id string, node_id string, created_at timestamp_ntz, removed_at timestamp_ntz")
    report = {(r.space, r.period): r for r in orphans.orphan_report(l1, l15, nodes).collect()}
    found = orphans.orphan_references(l1, l15, nodes).groupBy("ref_field", "period").count().collect()
    assert {(r.ref_field, r.period): r["count"] for r in found} == {k: r.orphaned for k, r in report.items() if r.orphaned}
    assert (report["from", "2025-01"].arrived, report["from", "2025-01"].orphaned) == (2, 1)
    assert (report["to", None].pending, report["to", "2025-01"].arrived, report["to", "2025-01"].pending) == (1, 2, 2)
    assert (report["source_nodes", None].orphaned, report["source_nodes", "2025-02"].pending) == (1, 3)
