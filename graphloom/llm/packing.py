"""Filling fixed-capacity containers with items, by bulk-synchronous best fit.

Items of one size are interchangeable, so the rounds run over size classes and over runs of containers with one gap;
there are no more classes than the capacity has tokens, however many documents there are. A round sorts classes and gaps
by size, sweeps both from large to small and gives each class the smallest gaps that hold it (its successors); of the
items that want one gap the largest wins, equal ones by rank. All gaps are updated together, and rounds repeat until
nothing is left. A container takes as many items of a class at once as fit; one at a time, a round for each item of the
fullest container would be needed.

The documents themselves are only counted, ranked within their size (hot sizes in slices, with offsets from the counts),
and look up which container has their rank.

Documents longer than the capacity are cut into full pieces, which fill containers of their own, and a rest. Nothing else
is cut.

Defined cases: documents without tokens go, whole, into container 0; a null, zero or negative capacity has no containers
and gives no rows; a budget that is repeated counts once; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.skew import HOT_ROWS
from graphloom.session import checkpoint

#: More budgets than this are not collected; the table of budgets is fixed and small.
MOST_BUDGETS = 1000
#: More size classes than this, over all budgets, are not gathered; it is an error, nothing is left out.
MOST_CLASSES = 5_000_000
#: Placements up to this many are broadcast (24 bytes each); beyond, they are joined.
MOST_BROADCAST = 1_000_000


def fill(capacity: int, classes: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit of items (size: count) into containers of capacity; none may be larger than it.

    Gives placements (size, first rank, items, first container, items a container) and the number of containers. Of a
    placement the items of ranks [first rank, first rank + items) lie in consecutive containers, so many in each.
    """
    left = {s: n for s, n in classes.items() if s > 0 and n > 0}
    rank = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # gap, first container, containers; ascending
    containers = 0
    while left:
        order = sorted(left, reverse=True)
        stack: list[tuple[int, int, int]] = []  # gaps that hold the class at hand, the smallest on top
        changed: list[tuple[int, int, int]] = []
        at, moved = len(gaps) - 1, False
        for size in order:
            while at >= 0 and gaps[at][0] >= size:
                stack.append(gaps[at])
                at -= 1
            while left[size] and stack:
                gap, first, count = stack.pop()
                fit = gap // size
                full, rest = divmod(left[size], fit)
                used = min(count, full)
                if used:
                    placed.append((size, rank[size], used * fit, first, fit))
                    changed.append((gap - fit * size, first, used))
                    rank[size] += used * fit
                    left[size] -= used * fit
                if used < count and left[size] and left[size] < fit:
                    placed.append((size, rank[size], rest, first + used, rest))
                    changed.append((gap - rest * size, first + used, 1))
                    rank[size] += rest
                    left[size] = 0
                    used += 1
                if used < count:
                    stack.append((gap, first + used, count - used))
                moved = True
        left = {s: n for s, n in left.items() if n}
        gaps = sorted([*gaps[: at + 1], *stack, *(x for x in changed if x[0] > 0)])
        if not moved and left:
            opened = -(-sum(s * n for s, n in left.items()) // capacity)
            insort(gaps, (capacity, containers, opened))
            containers += opened
    return placed, containers


def _items(counts: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """The pieces of every document for every capacity: budget_id, doc_id, piece_no, start, n_tokens, whole (fills a container)."""
    budgets = F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in capacities])
    n, c = F.col("n_tokens"), F.col("capacity")
    pieces = F.greatest(F.floor((n + c - 1) / c).cast("bigint"), F.lit(1).cast("bigint"))
    cut = counts.select("doc_id", "n_tokens", F.inline(budgets)).withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    cut = cut.withColumn("start", F.col("piece_no") * c)
    size = F.least(n - F.col("start"), c)
    return cut.select("budget_id", "doc_id", "piece_no", "start", size.alias("n_tokens"), ((n > c) & (size == c)).alias("whole"))


def packed(counts: DataFrame, budgets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Documents (doc_id, n_tokens) in containers of every capacity of budgets (budget_id, capacity_tokens).

    budget_id, doc_id, piece_no, start and n_tokens (of the piece), container_id: m-<number> for containers that are
    filled with items, f-<doc_id>-<piece_no> for those that one piece fills.
    """
    spark = counts.sparkSession
    rows = budgets.where("capacity_tokens > 0").select("budget_id", F.col("capacity_tokens").cast("bigint")).distinct().limit(MOST_BUDGETS + 1).collect()
    if len(rows) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    capacities = [(b, c) for b, c in rows]
    if not capacities:
        return spark.createDataFrame([], f"budget_id string, doc_id {dict(counts.dtypes)['doc_id']}, piece_no bigint, start bigint, n_tokens bigint, container_id string")
    columns = ["budget_id", "doc_id", "piece_no", "start", "n_tokens"]
    items = _items(counts, capacities)
    whole = items.where("whole").select(*columns, F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"))
    nothing = items.where("n_tokens = 0").select(*columns, F.lit("m-0").alias("container_id"))
    loose = items.where("not whole and n_tokens > 0")
    classes: dict[str, dict[int, int]] = {b: {} for b, _ in capacities}
    kinds = loose.groupBy("budget_id", "n_tokens").count().limit(MOST_CLASSES + 1).collect()  # at most a row a token of each capacity
    if len(kinds) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} different sizes over all budgets")
    for b, size, n in kinds:
        classes[b][size] = n
    runs = [(b, *run) for b, c in capacities for run in fill(c, classes[b])[0]]
    salts = F.broadcast(spark.createDataFrame([(b, s, -(-n // hot_rows)) for b, x in classes.items() for s, n in x.items() if n > hot_rows], "budget_id string, n_tokens bigint, slices bigint"))
    sliced = loose.join(salts, ["budget_id", "n_tokens"], "left")
    sliced = sliced.withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("slices"))))
    ranked = sliced.select(*columns, "slice", (F.row_number().over(Window.partitionBy("budget_id", "n_tokens", "slice").orderBy("doc_id", "piece_no")) - 1).cast("bigint").alias("rank"))
    if any(n > hot_rows for x in classes.values() for n in x.values()):
        hot = sliced.where(F.col("slices").isNotNull()).groupBy("budget_id", "n_tokens", "slice").count()  # a row for each hot_rows items
        before = F.sum("count").over(Window.partitionBy("budget_id", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        offsets = hot.select("budget_id", "n_tokens", "slice", F.coalesce(before, F.lit(0)).alias("offset"))
        ranked = ranked.join(offsets, ["budget_id", "n_tokens", "slice"], "left").withColumn("rank", F.col("rank") + F.coalesce("offset", F.lit(0))).drop("offset")
    found = _looked_up(ranked.select(*columns, "rank"), runs) if len(runs) <= MOST_BROADCAST else _joined(ranked.select(*columns, "rank"), runs)
    return whole.unionByName(nothing).unionByName(found)


def _looked_up(ranked: DataFrame, runs: list[tuple]) -> DataFrame:
    """The container of every rank, from placements that every executor has."""
    by: dict[str, list[np.ndarray]] = {}
    for b in {r[0] for r in runs}:
        own = np.array(sorted(r[1:] for r in runs if r[0] == b), dtype=np.int64)
        sizes, begins = np.unique(own[:, 0], return_index=True)
        by[b] = [sizes, np.append(begins, len(own)), own[:, 1], own[:, 3], own[:, 4]]
    shared = ranked.sparkSession.sparkContext.broadcast(by)
    names = ["budget_id", "doc_id", "piece_no", "start", "n_tokens", "container_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            budgets = part.column("budget_id").to_numpy(zero_copy_only=False)
            size, rank = (part.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "rank"))
            number = np.zeros(part.num_rows, np.int64)
            for b in set(budgets):
                mine = budgets == b
                sizes, begins, first, container, fit = shared.value[b]
                where, own, ranks = np.flatnonzero(mine), size[mine], rank[mine]
                for s in np.unique(own):  # the placements of a size lie together, in order of their first rank
                    k = np.searchsorted(sizes, s)
                    these = own == s
                    at = begins[k] + np.searchsorted(first[begins[k] : begins[k + 1]], ranks[these], side="right") - 1
                    number[where[these]] = container[at] + (ranks[these] - first[at]) // fit[at]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names[:-1]), pa.array([f"m-{n}" for n in number.tolist()])], names=names
            )

    kind = dict(ranked.dtypes)["doc_id"]
    return ranked.mapInArrow(run, f"budget_id string, doc_id {kind}, piece_no bigint, start bigint, n_tokens bigint, container_id string")


def _joined(ranked: DataFrame, runs: list[tuple]) -> DataFrame:
    """The container of every rank, by a join with the placements of its size."""
    table = ranked.sparkSession.createDataFrame(runs, "budget_id string, n_tokens bigint, first bigint, items bigint, container bigint, fit bigint")
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("items"))
    number = F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("fit"))
    return ranked.join(table, ["budget_id", "n_tokens"]).where(inside).select(
        "budget_id", "doc_id", "piece_no", "start", "n_tokens", F.concat(F.lit("m-"), number.cast("bigint").cast("string")).alias("container_id")
    )


def sized(counts: DataFrame) -> DataFrame:
    """Token counts, written once, as packing reads them twice."""
    return checkpoint(counts)


def fill_report(assignment: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, containers, tokens and unused share of each budget."""
    used = assignment.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    total = used.groupBy("budget_id").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    capacities = budgets.select("budget_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    room = F.col("n_containers") * F.col("capacity")
    return total.join(capacities, "budget_id").select("budget_id", "capacity", "n_containers", "n_tokens", ((room - F.col("n_tokens")) / room).alias("unused"))
