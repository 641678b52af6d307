import datetime as dt
import random

import pytest

from graphloom.operators import snapshot_delta as sd

F_DDL = "version_id string, feature_id string, label string, description string, loaded_at timestamp_ntz, change string"
R_DDL = "version_id string, from_feature string, to_feature string, relation string, loaded_at timestamp_ntz"
S_DDL = "version_id string, project_id string, timestamp string, d1 string"
T0 = dt.datetime(2025, 1, 1)


def brute(snaps, rows):
    valid = {}
    for kind, v, k1, k2, content, at in rows:
        key = (v, kind, k1, k2)
        if key not in valid or (at is not None and (valid[key][0] is None or at > valid[key][0])):
            valid[key] = (at, content)
    out = set()
    for project in {p for _, p, _ in snaps}:
        line = [v for v, p, t in sorted(((v, p, t) for v, p, t in snaps if p == project), key=lambda x: (dt.datetime.fromisoformat(x[2]), x[0]))]
        for old, new in zip(line, line[1:]):
            a = {k[1:]: c for k, (_, c) in valid.items() if k[0] == old}
            b = {k[1:]: c for k, (_, c) in valid.items() if k[0] == new}
            for k in a.keys() | b.keys():
                if k not in a:
                    out.add((new, *k, "added"))
                elif k not in b:
                    out.add((new, *k, "removed"))
                elif a[k] != b[k]:
                    out.add((new, *k, "changed"))
    return out


@pytest.mark.parametrize(("seed", "chunk_rows", "hot_rows"), [(1, 4, 10**6), (2, 1, 10**6), (3, 1000, 10**6), (4, 4, 20)])
def test_brute_force(spark, seed, chunk_rows, hot_rows):
    rng = random.Random(seed)
    snaps, features, relations, rows = [], [], [], []
    for p in ("p", "q", None):
        for i in range(5):
            v = f"{p}-{i}"
            snaps.append((v, p, rng.choice([f"2025-0{i + 1}-02T03:04:05Z", f"2025-0{i + 1}-02T03:04:05.5+08:00", f"2025-0{i + 1}-02T03:04:05+00:00"])))
            for k in range(40 if i != 2 else 0):
                if rng.random() < 0.8:
                    for again in range(rng.choice([1, 1, 2])):
                        key = f"f{k}" if k else None
                        x, y = (f"l{k}", f"d{k}") if rng.random() < 0.9 else (rng.choice([None, "", "x"]), rng.choice([None, "", "z"]))
                        at = T0 + dt.timedelta(hours=again)
                        features.append((v, key, x, y, at, "clash"))
                        rows.append(("feature", v, key, "", (x, y), at))
                        relations.append((v, key, f"f{k % 7}", x, at))
                        rows.append(("relation", v, key, f"f{k % 7}", x, at))
    f, r = spark.createDataFrame(features, F_DDL), spark.createDataFrame(relations, R_DDL)
    got = sd.snapshot_changes(sd.feature_and_relation_records(f, r), spark.createDataFrame([(*s, "clash") for s in snaps], S_DDL), chunk_rows, hot_rows)
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len({*found}) and {*found} == brute(snaps, rows)


def test_matching_chunks_are_discarded(spark):
    features = [(v, f"f{k}", "l", "d" if (v, k) != ("b", 77) else "other", T0, "") for v in "ab" for k in range(400)]
    cut = sd.chunked(sd.records(spark.createDataFrame(features, F_DDL), "feature", "feature_id", None, ["label", "description"]), None, 8)
    pairs = spark.createDataFrame([("b", "a")], "version_id string, previous_id string")
    assert sd.changed_chunks(cut, pairs).count() == 2  # one chunk, on both sides
    assert cut.select("chunk").distinct().count() > 20


def test_empty_and_unreadable(spark):
    f, r, s = (spark.createDataFrame([], x) for x in (F_DDL, R_DDL, S_DDL))
    assert sd.snapshot_changes(sd.feature_and_relation_records(f, r), s).count() == 0
    snaps = spark.createDataFrame([("a", "p", "2025-01-01T00:00:00Z", ""), ("b", "p", "no time", ""), ("c", "p", None, "")], S_DDL)
    rows = spark.createDataFrame([("b", "f", "l", "d", T0, "")], F_DDL)
    assert sd.snapshot_changes(sd.feature_and_relation_records(rows, r), snaps).count() == 0
