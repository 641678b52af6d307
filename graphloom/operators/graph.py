"""Reachability, components, pruning and layers of graphs, by rounds of joins; chunks of them by bounded folds.

Rounds stop when nothing changes; their lineage is cut by checkpoints. keys (say version_id) let one run cover many graphs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint

MOST_HOPS = 2
BAND = 8
#: Edges of a connected component that one task walks.
MOST_WALKED = 1_000_000
#: Edges of a scope that goes to one task whole, and rows that a task gathers about.
MOST_GATHERED = 300_000
PER_BIN = 50_000


def undirected(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct neighbours in both directions between known, different nodes: keys..., a, b."""
    ids = nodes.select(*keys, "node_id").distinct()
    known = edges.where("from_node <> to_node").join(ids.withColumnRenamed("node_id", "from_node"), [*keys, "from_node"], "left_semi").join(
        ids.withColumnRenamed("node_id", "to_node"), [*keys, "to_node"], "left_semi"
    )
    ends = F.inline(F.array(F.struct(F.col("from_node").alias("a"), F.col("to_node").alias("b")), F.struct(F.col("to_node").alias("a"), F.col("from_node").alias("b"))))
    return known.select(*keys, ends).distinct()


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., node_id, component: the least node id of what is connected.

    Each round a node takes the least label of itself and its neighbours and then its label's label, so labels travel
    twice as far every round and paths of length n take about log n rounds.
    """
    near = checkpoint(undirected(nodes, edges, keys))
    labels = checkpoint(nodes.select(*keys, "node_id", F.col("node_id").alias("component")).distinct())
    while True:
        least = near.join(labels.withColumnsRenamed({"node_id": "b"}), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("component").alias("low")).withColumnRenamed("a", "node_id")
        lowered = labels.join(least, [*keys, "node_id"], "left").select(*keys, "node_id", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("via"))
        jump = lowered.select(*keys, F.col("node_id").alias("via"), F.col("via").alias("far"))
        moved = checkpoint(lowered.join(jump, [*keys, "via"]).select(*keys, "node_id", "old", F.least("via", "far").alias("component")))
        labels = moved.drop("old")
        if moved.where("component <> old").limit(1).count() == 0:
            return labels


def reach(starts: DataFrame, edges: DataFrame, keys: list[str], most_hops: int | None = None) -> DataFrame:
    """keys..., source, node_id, hops: all that is reached from starts (keys..., source, node_id) and the fewest hops to it.

    Each round only what is new goes on; without most_hops until nothing is.
    """
    step = edges.select(*keys, F.col("from_node").alias("node_id"), "to_node").distinct()
    found = checkpoint(starts.select(*keys, "source", "node_id", F.lit(0).cast("bigint").alias("hops")).distinct())
    front, hops = found, 0
    while most_hops is None or hops < most_hops:
        hops += 1
        ahead = front.join(step, [*keys, "node_id"]).select(*keys, "source", F.col("to_node").alias("node_id")).distinct()
        front = checkpoint(ahead.join(found, [*keys, "source", "node_id"], "left_anti").withColumn("hops", F.lit(hops).cast("bigint")))
        if front.limit(1).count() == 0:
            break
        found = checkpoint(found.unionByName(front))
    return found


def linked(pairs: DataFrame, owned: DataFrame, edges: DataFrame, keys: list[str], scope: list[str], most: int = MOST_GATHERED) -> DataFrame:
    """The pairs (keys..., from_feature, to_feature) whose nodes a path of edges (scope..., from_node, to_node) of any length joins.

    owned is (keys..., scope..., feature_id, node_id), keys are texts. A node that both features own is a path. No path leaves a scope or a
    connected component, so tasks walk whole scopes, or the components of a scope of more than `most` edges, and only pairs
    that are found leave them. Components of more than MOST_WALKED edges are walked by rounds of joins.
    """
    own = owned.where(F.col("node_id").isNotNull()).select(*keys, *scope, "feature_id", "node_id").distinct()
    asked = pairs.select(*keys, "from_feature", "to_feature").distinct()
    begun = checkpoint(asked.join(own.withColumnRenamed("feature_id", "from_feature"), [*keys, "from_feature"]))
    ends = checkpoint(own.withColumnRenamed("feature_id", "to_feature").join(asked, [*keys, "to_feature"], "left_semi"))
    lines = checkpoint(edges.select(*scope, "from_node", "to_node").dropna())
    sizes = lines.groupBy(*scope).agg(F.count("*").alias("n"))
    total = int(sizes.agg(F.sum("n")).first()[0] or 0) + ends.count()
    large = checkpoint(sizes.where(F.col("n") > most).select(*scope))
    parts = huge = None
    if not large.isEmpty():
        inside = checkpoint(lines.join(large, scope, "left_semi"))
        parts, numbered = _numbered_components(inside, scope)
        sized = numbered.groupBy("component").count()
        huge = checkpoint(sized.where(F.col("count") > MOST_WALKED).select("component"))
    bins = max(1, total // PER_BIN)

    def placed(df: DataFrame, node: str) -> DataFrame:
        if parts is None:
            return df.withColumn("bin", F.pmod(F.hash(*scope), F.lit(bins)))
        met = df.join(parts.withColumnRenamed("node_id", node), [*scope, node], "left").join(huge, "component", "left_anti")
        return met.withColumn("bin", F.pmod(F.hash(*scope, "component"), F.lit(bins))).select(*df.columns, "bin")

    none = F.lit(None).cast("string")
    rows = [
        placed(lines, "from_node").select("bin", *scope, *[F.lit(None).cast(t).alias(k) for k, t in begun.select(*keys).dtypes], none.alias("from_feature"), none.alias("to_feature"), F.col("from_node").alias("node_id"), "to_node"),
        placed(begun, "node_id").select("bin", *scope, *keys, "from_feature", "to_feature", "node_id", none.alias("to_node")),
        placed(ends, "node_id").select("bin", *scope, *keys, none.alias("from_feature"), "to_feature", "node_id", none.alias("to_node")),
    ]
    kinds = dict(begun.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "from_feature", "to_feature"))
    out = [*keys, "from_feature", "to_feature"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        split = [pdf[pdf["to_node"].notna()], pdf[pdf["from_feature"].notna()], pdf[pdf["to_node"].isna() & pdf["from_feature"].isna()]]
        lists = [zip(zip(*[x[c] for c in scope], strict=True), zip(*[x[c] for c in keys], strict=True), x["from_feature"], x["to_feature"], x["node_id"], x["to_node"], strict=True) for x in split]
        return pd.DataFrame([(*k, a, b) for k, a, b in joined_pairs(*map(list, lists))], columns=out)

    found = reduce(DataFrame.unionByName, rows).groupBy("bin").applyInPandas(run, ddl)
    if huge is not None and not huge.isEmpty():
        inside = parts.join(huge, "component", "left_semi").select(*scope, "node_id")
        hard = begun.join(inside, [*scope, "node_id"], "left_semi").withColumnRenamed("node_id", "source")
        step = lines.join(inside.withColumnRenamed("node_id", "from_node"), [*scope, "from_node"], "left_semi")
        reached = reach(hard.select(*scope, "source", F.col("source").alias("node_id")), step, scope)
        found = found.unionByName(hard.join(reached, [*scope, "source"]).join(ends, [*keys, *scope, "to_feature", "node_id"], "left_semi").select(*out))
    return found.distinct()


def _numbered_components(edges: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """scope..., node_id, component (a number), and the edges as numbers with their component: rounds move numbers, not texts."""
    ids = checkpoint(edges.select(*scope, F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct().withColumn("id", F.monotonically_increasing_id()))
    met = edges
    for end in ("from", "to"):
        met = met.join(ids.withColumnsRenamed({"node_id": f"{end}_node", "id": f"{end}_id"}), [*scope, f"{end}_node"])
    links = checkpoint(met.select(F.col("from_id").alias("from_node"), F.col("to_id").alias("to_node")))
    found = components(ids.select(F.col("id").alias("node_id")), links, [])
    parts = checkpoint(ids.join(found.withColumnRenamed("node_id", "id"), "id").select(*scope, "node_id", "component"))
    return parts, links.join(found.withColumnRenamed("node_id", "from_node"), "from_node")


def joined_pairs(edges: list[tuple], starts: list[tuple], ends: list[tuple]) -> set[tuple]:
    """(key, from_feature, to_feature) of starts from which edges lead to a node of ends; each row is (scope, key, from_feature, to_feature, node, next node)."""
    ahead: dict[tuple, list[str]] = {}
    for scope, _, _, _, a, b in edges:
        ahead.setdefault((scope, a), []).append(b)
    goals: dict[tuple, set[str]] = {}
    for scope, key, _, to, n, _ in ends:
        goals.setdefault((scope, key, to), set()).add(n)
    wanted: dict[tuple, set[tuple]] = {}
    for scope, key, a, b, n, _ in starts:
        if (scope, key, b) in goals:
            wanted.setdefault((scope, n), set()).add((key, a, b))
    found: set[tuple] = set()
    for (scope, source), asked in wanted.items():
        asked = asked - found
        if not asked:
            continue
        seen, stack = {source}, [source]
        while stack:
            for m in ahead.get((scope, stack.pop()), ()):
                if m not in seen:
                    seen.add(m)
                    stack.append(m)
        found |= {(k, a, b) for k, a, b in asked if not seen.isdisjoint(goals[scope, k, b])}
    return found


def pruned(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., node_id, round: seeds (round 0), and every node whose upstream nodes are all pruned, in the round it follows."""
    links = checkpoint(edges.select(*keys, "from_node", "to_node").distinct())
    total = links.groupBy(*keys, "to_node").agg(F.count("*").alias("n_upstream"))
    done = checkpoint(seeds.select(*keys, "node_id").distinct().withColumn("round", F.lit(0).cast("bigint")))
    number = 0
    while True:
        number += 1
        gone = links.join(done.select(*keys, F.col("node_id").alias("from_node")), [*keys, "from_node"], "left_semi").groupBy(*keys, "to_node").agg(F.count("*").alias("n_gone"))
        full = gone.join(total, [*keys, "to_node"]).where("n_gone = n_upstream").select(*keys, F.col("to_node").alias("node_id"))
        new = checkpoint(full.join(done, [*keys, "node_id"], "left_anti").withColumn("round", F.lit(number).cast("bigint")))
        if new.limit(1).count() == 0:
            return done
        done = checkpoint(done.unionByName(new))


def reinstated(done: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """What stays pruned once some nodes are taken back; nothing follows from it."""
    return done.join(again, [*keys, "node_id"], "left_anti")


def verdicts(relations: DataFrame, owned: DataFrame, nodes: DataFrame, reached: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the graph backs each relation: not_assessed, conceptual, undetermined, backed or gap.

    owned is (keys..., feature_id, node_id), reached (keys..., source: a feature_id, node_id, hops).
    """
    known = owned.join(nodes.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_semi")
    there = known.select(*keys, F.col("feature_id").alias("to_feature")).distinct().withColumn("there", F.lit(True))
    hits = reached.join(known.withColumnRenamed("feature_id", "to_feature"), [*keys, "node_id"]).groupBy(*keys, F.col("source").alias("from_feature"), "to_feature").agg(F.min("hops").alias("hops"))
    met = relations.join(there, [*keys, "to_feature"], "left").join(hits, [*keys, "from_feature", "to_feature"], "left")
    verdict = F.when(F.col("relation_type").isNull(), "not_assessed").when(F.col("relation_type") == "inferred", "conceptual").when(F.col("there").isNull(), "undetermined").when(
        F.col("hops").isNotNull(), "backed"
    ).otherwise("gap")
    return met.select(*relations.columns, verdict.alias("verdict"), F.when(verdict == "backed", F.col("hops")).alias("hops"))


VERDICTS = ["backed", "gap", "undetermined", "conceptual", "not_assessed"]


def badges(judged: DataFrame, keys: list[str]) -> DataFrame:
    """The worst verdict of a feature's relations: gap, undetermined, backed or none."""
    worst = F.max(F.when(F.col("verdict") == "gap", 3).when(F.col("verdict") == "undetermined", 2).when(F.col("verdict") == "backed", 1).otherwise(0))
    return judged.groupBy(*keys, F.col("from_feature").alias("feature_id")).agg(F.element_at(F.array(*map(F.lit, ("none", "backed", "undetermined", "gap"))), (worst + 1).cast("int")).alias("badge"))


def verdict_counts(judged: DataFrame) -> DataFrame:
    """Relations by verdict, those that never occur with zero."""
    all_of = judged.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return all_of.join(judged.groupBy("verdict").agg(F.count("*").alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_relations"))


def isolated(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with whether any edge, loops aside, touches them."""
    ends = edges.where("from_node <> to_node").select(*keys, F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct().withColumn("linked", F.lit(True))
    return nodes.select(*keys, "node_id").distinct().join(ends, [*keys, "node_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def columns(edges: DataFrame, keys: list[str], most: int = MOST_WALKED) -> DataFrame:
    """keys..., node_id, depth, column of the nodes that edges, loops aside, touch.

    depth is the longest path down from the node when back edges are left out, column the graph's greatest depth less it.
    """
    found = _walked(edges, keys, most).where("to_node is null").select(*keys, F.col("from_node").alias("node_id"), "depth")
    deepest = found.groupBy(*keys).agg(F.max("depth").alias("deepest")) if keys else found.agg(F.max("depth").alias("deepest"))
    met = found.join(deepest, keys) if keys else found.crossJoin(F.broadcast(deepest))  # one row
    return met.select(*keys, "node_id", "depth", (F.col("deepest") - F.col("depth")).alias("column"))


def back_edges(edges: DataFrame, keys: list[str], most: int = MOST_WALKED) -> DataFrame:
    """keys..., from_node, to_node: the edges that lead back to an open node of the depth-first walk by node id; loops don't count."""
    return _walked(edges, keys, most).where("to_node is not null").select(*keys, "from_node", "to_node")


def _walked(edges: DataFrame, keys: list[str], most: int) -> DataFrame:
    """A row for each node (to_node null) with its depth, and one for each back edge.

    A walk is sequential but never leaves a connected component, so each component is walked by one task. One with more
    than `most` edges is an error: the walk's order can't be split, and it must not be gathered.
    """
    links = edges.where("from_node <> to_node").select(*keys, "from_node", "to_node").distinct()
    links = checkpoint(links)
    nodes = links.select(*keys, F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct()
    parts = components(nodes, links, keys)
    placed = checkpoint(links.join(parts.withColumnRenamed("node_id", "from_node"), [*keys, "from_node"]))
    if not placed.groupBy(*keys, "component").count().where(F.col("count") > most).isEmpty():
        raise ValueError(f"a connected component has more than {most} edges")
    ddl = ", ".join([*(f"`{k}` {dict(edges.dtypes)[k]}" for k in keys), "from_node string", "to_node string", "depth bigint"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = walk_down(list(zip(pdf["from_node"], pdf["to_node"], strict=True)))
        out = pd.DataFrame(found, columns=["from_node", "to_node", "depth"], dtype=object)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return placed.groupBy(*keys, "component").applyInPandas(run, ddl)


def banded(placed: DataFrame, keys: list[str], order: list[str], band: int = BAND) -> DataFrame:
    """The sub-column of every node of a column: bands of `band` nodes in order."""
    from graphloom.operators.skew import ranked

    return ranked(placed, keys, [F.col(c) for c in order], "place").withColumn("band", F.floor((F.col("place") - 1) / band).cast("bigint")).drop("place")


def merged_chunks(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of the features of all chunks (chunk_id, feature_id, ...), and its errors: (error, feature_id, chunks).

    A feature without an id, and one whose id more than one row has, is an error, and the union then not to be used. An
    error names its first two chunks and how many rows there are.
    """
    named = F.coalesce("feature_id", F.lit("")) != ""
    missing = features.where(~named).groupBy("chunk_id").count().select(F.lit("missing_id").alias("error"), F.lit(None).cast("string").alias("feature_id"), F.col("chunk_id").alias("first_chunk"), F.lit(None).cast("string").alias("last_chunk"), F.col("count").alias("n"))
    twice = features.where(named).groupBy("feature_id").agg(F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"), F.count("*").alias("n")).where("n > 1")
    return features.where(named), missing.unionByName(twice.select(F.lit("duplicate_id").alias("error"), "feature_id", "first_chunk", "last_chunk", "n"))


def node_features(owned: DataFrame, keys: list[str]) -> DataFrame:
    """The one feature of every node, the least of its owners, and how many own it."""
    return owned.groupBy(*keys, "node_id").agg(F.min("feature_id").alias("feature_id"), F.countDistinct("feature_id").alias("n_owners"))


def lifted(edges: DataFrame, of_node: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Relations between features that edges between their nodes imply, and the edges that lack a feature at an end."""
    a, b = [of_node.select(*keys, F.col("node_id").alias(n), F.col("feature_id").alias(f)) for n, f in (("from_node", "from_feature"), ("to_node", "to_feature"))]
    met = edges.join(a, [*keys, "from_node"], "left").join(b, [*keys, "to_node"], "left")
    whole = F.col("from_feature").isNotNull() & F.col("to_feature").isNotNull()
    return met.where(whole & (F.col("from_feature") != F.col("to_feature"))).select(*keys, "from_feature", "to_feature", "type").distinct(), met.where(~whole)


def crossing(edges: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """Undirected edges whose ends lie in different chunks (placed: keys..., node_id, chunk_id), counted once."""
    a, b = [placed.select(*keys, F.col("node_id").alias(x), F.col("chunk_id").alias(f"c_{x}")) for x in ("a", "b")]
    pairs = edges.where("a < b").join(a, [*keys, "a"]).join(b, [*keys, "b"])
    return pairs.groupBy(*keys).agg(F.count(F.when(F.col("c_a") != F.col("c_b"), 1)).alias("n_cross"), F.count("*").alias("n_edges"))


def regimes(sized: DataFrame, keys: list[str], target: int, ratio: int = 8, most: int = 2_000_000) -> DataFrame:
    """small, medium, large or too_large for each graph by the sum of its nodes' token estimates."""
    total = sized.groupBy(*keys).agg(F.sum("tokens").alias("total"))
    regime = F.when(F.col("total") > most, "too_large").when(F.col("total") <= target, "small").when(F.col("total") <= ratio * target, "medium").otherwise("large")
    return total.withColumn("regime", regime)


def chunk_plan(nodes: list[tuple[str, int]], near: dict[str, set[str]], in_degree: dict[str, int], target: int) -> list[tuple[str, str, str]]:
    """Of one graph of bounded size: node_id, chunk_id and tier.

    Components that fit are packed, the largest first, each into the first chunk with room. One that doesn't fit is walked
    breadth first from its node of highest in-degree and cut where a chunk is full; a node over the target is alone.
    """
    tokens = dict(nodes)
    seen: set[str] = set()
    fitting: list[tuple[list[str], int]] = []
    chunks: list[tuple[list[str], str]] = []
    rank = lambda n: (-in_degree.get(n, 0), n)
    for start in sorted(tokens):
        if start in seen:
            continue
        group, stack = [], [start]
        seen.add(start)
        while stack:
            n = stack.pop()
            group.append(n)
            fresh = near.get(n, set()) - seen
            seen |= fresh
            stack.extend(fresh)
        weight = sum(tokens[n] for n in group)
        if weight <= target:
            fitting.append((sorted(group), weight))
            continue
        walked, queue = {min(group, key=rank)}, [min(group, key=rank)]
        for n in queue:
            fresh = sorted(near.get(n, set()) - walked, key=rank)
            walked.update(fresh)
            queue.extend(fresh)
        held: list[str] = []
        used = 0
        for n in queue:
            alone = tokens[n] > target
            if held and (alone or used + tokens[n] > target):
                chunks.append((held, "bisect"))
                held, used = [], 0
            if alone:
                chunks.append(([n], "oversized"))
            else:
                held.append(n)
                used += tokens[n]
        if held:
            chunks.append((held, "bisect"))
    bins: list[list] = []
    for group, weight in sorted(fitting, key=lambda x: (-x[1], x[0][0])):
        room = next((b for b in bins if b[1] + weight <= target), None)
        if room is None:
            bins.append([list(group), weight])
        else:
            room[0] += group
            room[1] += weight
    chunks += [(b[0], "cohesion") for b in bins]
    ordered = sorted(((sorted(g), tier) for g, tier in chunks), key=lambda x: x[0][0])
    return [(n, f"chunk-{i:03d}", tier) for i, (g, tier) in enumerate(ordered, 1) for n in g]


def chunks(sized: DataFrame, edges: DataFrame, key: str, target: int, ratio: int = 8, most: int = 2_000_000) -> DataFrame:
    """key, node_id, chunk_id and tier of every node of the graphs that are not too large.

    A graph of more than `most` tokens is refused before anything is gathered, so no group is larger than that.
    """
    regime = regimes(sized, [key], target, ratio, most)
    small = sized.join(regime.where("regime = 'small'"), key).select(key, "node_id", F.lit("chunk-001").alias("chunk_id"), F.lit("whole").alias("tier"))
    split = regime.where("regime in ('medium', 'large')").select(key)
    near = undirected(sized, edges, [key]).groupBy(key, F.col("a").alias("node_id")).agg(F.sort_array(F.collect_list("b")).alias("near"))
    degree = edges.groupBy(key, F.col("to_node").alias("node_id")).agg(F.count("*").alias("in_degree"))
    rows = sized.select(key, "node_id", "tokens").join(split, key, "left_semi").join(near, [key, "node_id"], "left").join(degree, [key, "node_id"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near_of = {n: set(x) if x is not None else set() for n, x in zip(pdf["node_id"], pdf["near"], strict=True)}
        degrees = {n: int(d) if d == d and d is not None else 0 for n, d in zip(pdf["node_id"], pdf["in_degree"], strict=True)}
        plan = chunk_plan(list(zip(pdf["node_id"], map(int, pdf["tokens"]), strict=True)), near_of, degrees, target)
        out = pd.DataFrame(plan, columns=["node_id", "chunk_id", "tier"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return small.unionByName(rows.groupBy(key).applyInPandas(run, f"{key} string, node_id string, chunk_id string, tier string"))


def walk_down(edges: list[tuple[str, str]]) -> list[tuple[str, str | None, int | None]]:
    """Of a bounded graph: (node, None, depth) of every node and (from, to, None) of every back edge.

    Depth-first by node id; a node is left when all below it are, so its depth is known then.
    """
    out: dict[str, set[str]] = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
    found: list[tuple[str, str | None, int | None]] = []
    opened: set[str] = set()
    depth: dict[str, int] = {}
    for top in sorted(out):
        if top in depth:
            continue
        opened.add(top)
        stack = [(top, iter(sorted(out[top])), [0])]
        while stack:
            n, rest, deepest = stack[-1]
            for m in rest:
                if m in depth:
                    deepest[0] = max(deepest[0], depth[m] + 1)
                elif m in opened:
                    found.append((n, m, None))
                else:
                    opened.add(m)
                    stack.append((m, iter(sorted(out[m])), [0]))
                    break
            else:
                stack.pop()
                opened.discard(n)
                depth[n] = deepest[0]
                if stack:
                    stack[-1][2][0] = max(stack[-1][2][0], depth[n] + 1)
    return found + [(n, None, d) for n, d in depth.items()]
