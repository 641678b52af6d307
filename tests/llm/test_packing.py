import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import packing

BUDGETS = [("a", 10, "n"), ("b", 37, None), ("c", 1, ""), ("none", None, ""), ("zero", 0, ""), ("a", 10, "again")]
B_DDL, C_DDL = "budget_id string, capacity_tokens int, note string", "doc_id bigint, n_tokens bigint, capacity string"


@pytest.mark.parametrize("seed", range(12))
def test_fill(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 50, 1000])
    classes = Counter(rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 30, 3000])))
    placed, n = packing.fill(capacity, classes)
    used, ranks = defaultdict(int), defaultdict(list)
    for size, first, items, container, fit in placed:
        for r in range(items):
            used[container + r // fit] += size
            ranks[size].append(first + r)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: [*range(c)] for s, c in classes.items() if c}
    assert all(0 < u <= capacity for u in used.values()) and {*used} <= {*range(n)}
    total = sum(s * c for s, c in classes.items())
    assert len(used) <= max(-(-total // capacity) * 11 / 9 + 2, 1)


@pytest.mark.parametrize(("hot_rows", "most"), [(10**6, 10**6), (3, 10**6), (10**6, 0), (3, 0)])
def test_packed(spark, monkeypatch, hot_rows, most):
    monkeypatch.setattr(packing, "MOST_BROADCAST", most)
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 2, 3, 10, 11, 25, 37, 38, 100, 5, 5, 5, 5]) for i in range(300)}
    out = packing.packed(spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], C_DDL), spark.createDataFrame(BUDGETS, B_DDL), hot_rows).collect()
    for budget, capacity in (("a", 10), ("b", 37), ("c", 1)):
        rows = [r for r in out if r.budget_id == budget]
        pieces, used = defaultdict(list), defaultdict(int)
        for r in rows:
            pieces[r.doc_id].append((r.start, r.n_tokens))
            used[r.container_id] += r.n_tokens
        assert max(used.values()) <= capacity and {*pieces} == {*sizes}
        for doc, parts in pieces.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == sizes[doc] and (len(parts) == 1 or sizes[doc] > capacity)
        assert len([u for u in used.values() if u]) <= -(-sum(sizes.values()) // capacity) * 1.1 + 1
    assert {r.budget_id for r in out} == {"a", "b", "c"}


def test_empty(spark):
    counts, budgets = spark.createDataFrame([], C_DDL), spark.createDataFrame(BUDGETS, B_DDL)
    assert packing.packed(counts, budgets).count() == 0
    assert packing.packed(spark.createDataFrame([(1, 2, "")], C_DDL), budgets.limit(0)).count() == 0
    report = packing.fill_report(packing.packed(spark.createDataFrame([(1, 20, "")], C_DDL), budgets), budgets)
    assert {r.budget_id: (r.n_containers, r.n_tokens) for r in report.collect()} == {"a": (2, 20), "b": (1, 20), "c": (20, 20)}


def test_sizes_and_ranks_of_any_magnitude(spark):
    """Sizes beyond 2^23 tokens, whose product with a rank's range would not fit a number."""
    big = 2**33
    counts = spark.createDataFrame([(i, big + i % 3, "x") for i in range(60)], C_DDL)
    budgets = spark.createDataFrame([("w", 2**31 - 1, "")], B_DDL)
    rows = packing.packed(counts, budgets).collect()
    assert sum(r.n_tokens for r in rows) == sum(big + i % 3 for i in range(60))
    used = defaultdict(int)
    for r in rows:
        used[r.container_id] += r.n_tokens
    assert max(used.values()) <= 2**31 - 1
