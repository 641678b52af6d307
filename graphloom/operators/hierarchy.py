"""Full hierarchies from parent-child links.

Links lie in groups (for blocks: a version) and never leave them. Groups of up to `bound` rows are put together in one
row each, split into connected components by union-find, and each component is walked depth-first with node colours; an
edge to a node that is still open closes a cycle. Larger groups are split into connected components first, by pointer
jumping over checkpointed tables, and every component of up to `bound` rows is then walked in the same way; the rows of
still larger components take root and depth from the jumps, and their place in the walk from the ranks of its tour
(entering and leaving each node), which are jumps along one list; both are exact and gather nothing.

The walk numbers the nodes of a component as it enters them, children by id. A node's descendants are the nodes of its
component with numbers after its own (`first`) up to the last below it (`last`), and its path are those whose range holds
its number: one row a node stands for all of its ancestors and descendants, however deep. Paths and pairs written out
(`path`, `descendants`) grow with depth, as their results do, and leave a task in batches of bounded size.

Defined cases: a row without a node id or group names no node and gives no row; of several rows of a node the one loaded
last is valid (null is earliest; of rows loaded at the same time the greatest parent); a parent that is null, blank or no
node of its group makes a root of depth 0; a node on a cycle or leading into one has root '', depth -1 and the path and
numbers of a walk from the least node of that cycle (top), but no descendants; a node that is its own parent is a cycle
of one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import HOT_ROWS, hot_keys, is_blank, looked_up, ranked, with_hot
from graphloom.session import checkpoint, dropped

BOUND = 100_000
_OUT = "grp string, node string, root string, depth bigint"
_MORE = {
    "path": ", path array<string>", "children": ", n_descendants bigint", "interval": ", top string, first bigint, last bigint", "back": ", back_edge boolean"
}
#: A batch of results has about so many values at most, those of a row's path counted.
_CELLS = 200_000


def components(parent: dict[str, str | None]) -> list[list[str]]:
    """The connected components of one group, by union-find with path halving."""
    top = {n: n for n in parent}

    def find(n: str) -> str:
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for n, p in parent.items():
        if p is not None:
            a, b = find(n), find(p)
            if a != b:
                top[a] = b
    parts: dict[str, list[str]] = {}
    for n in parent:
        parts.setdefault(find(n), []).append(n)
    return list(parts.values())


def walk(members: list[str], parent: dict[str, str | None]) -> tuple[str, bool, dict[str, int], dict[str, int], dict[str, int], set[str]]:
    """Of one component: the node the walk starts at, whether that is a root, each node's depth below it, its number, the last number below it, the back edges.

    A component without a root holds one cycle; the walk then starts at the least node on it, and the edge that leads
    back to an open node, given by its lower end, is the back edge.
    """
    children: dict[str, list[str]] = {n: [] for n in members}
    root = None
    for n in members:
        p = parent[n]
        if p is None:
            root = n
        else:
            children[p].append(n)
    start = root
    if start is None:
        seen, n = set(), members[0]
        while n not in seen:
            seen.add(n)
            n = parent[n]
        start, m = n, parent[n]
        while m != n:
            start, m = min(start, m), parent[m]
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(members, white)
    colour[start] = grey
    depth, first, last, back, stack = {start: 0}, {start: 0}, {}, set(), [(start, iter(sorted(children[start])))]
    while stack:
        node, below = stack[-1]
        for child in below:
            if colour[child] == white:
                colour[child] = grey
                depth[child], first[child] = len(stack), len(first)
                stack.append((child, iter(sorted(children[child]))))
                break
            if colour[child] == grey:
                back.add(child)
        else:
            colour[node] = black
            last[node] = len(first) - 1
            stack.pop()
    return start, root is not None, depth, first, last, back


def _line(node: str, start: str, parent: dict[str, str | None]) -> list[str]:
    line = [node]
    while line[-1] != start:
        line.append(parent[line[-1]])
    return line[::-1]


def _rows(group: str, nodes: list[tuple[str, str | None]], more: tuple[str, ...]) -> Iterator[tuple]:
    ids = {n for n, _ in nodes}
    parent = {n: (p if p in ids else None) for n, p in nodes}
    for members in components(parent):
        start, tree, depth, first, last, back = walk(members, parent)
        for n in members:
            row = [group, n, start if tree else "", depth[n] if tree else -1]
            for m in more:
                if m == "path":
                    row.append(_line(n, start, parent))
                elif m == "children":
                    row.append(last[n] - first[n] if tree else None)
                elif m == "interval":
                    row += [start, first[n], last[n]]
                else:
                    row.append(n in back)
            yield tuple(row)


def _visit(schema: pa.Schema, more: tuple[str, ...]):
    width, wide = len(schema), schema.get_field_index("path")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        cells = 0
        for part in batches:
            for group, nodes in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                values = nodes.values
                for row in _rows(group, list(zip(values.field(0).to_pylist(), values.field(1).to_pylist(), strict=True)), more):
                    out.append(row)
                    cells += width + (len(row[wide]) if wide >= 0 else 0)
                    if cells >= _CELLS:
                        yield batch(out)
                        out, cells = [], 0
        if out:
            yield batch(out)

    return run


def links(df: DataFrame, group: str, node: str, parent: str, loaded: str) -> DataFrame:
    """The valid link of each node: grp, node, parent (null for none)."""
    named = df.where(F.col(group).isNotNull() & F.col(node).isNotNull())
    value = F.when(~is_blank(F.col(parent)), F.col(parent))
    valid = named.groupBy(F.col(group).alias("grp"), F.col(node).alias("node")).agg(F.max(F.struct(F.col(loaded).alias("l"), value.alias("p"))).alias("r"))
    return valid.select("grp", "node", F.col("r.p").alias("parent"))


def _gathered(rows: DataFrame, keys: list[str], more: tuple[str, ...], label: str) -> DataFrame:
    """Each group of keys, known to be bounded, walked as a whole."""
    ddl = _OUT + "".join(_MORE[m] for m in more)
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct("node", "parent")).alias("nodes")).select(label, "nodes")
    return packed.mapInArrow(_visit(schema, more), ddl)


def jumped(rows: DataFrame, lines: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Of each link (grp, node, parent): far, depth, low, done and, if asked, line, its ancestors with the nearest first.

    Pointer jumping: a node's pointer skips to its pointer's pointer, so chains halve each round and paths of any depth
    need as many rounds as the depth has bits. done: far is the root (the node itself, if it is one). What still moves
    after the bits of the row count leads into a cycle; far is then on the cycle, and of a node on it low is the cycle's
    least node. Lines are for links without cycles. Nodes that too many others point to are brought to them, so a star
    stays where it lies; with lines, which are wide, that is left to the adaptive join.
    """
    known = rows.select("grp", F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.col("parent"))
    top = up.isNull()
    state = looked_up(rows, known, ["grp", "parent"], hot_keys(rows, ["grp", "parent"], hot_rows), "left").select(
        "grp", "node", F.coalesce(up, "node").alias("far"), F.when(top, 0).otherwise(1).cast("bigint").alias("depth"),
        F.least("node", F.coalesce(up, "node")).alias("low"), top.alias("done"),
        *([F.when(top, F.array().cast("array<string>")).otherwise(F.array(up)).alias("line")] if lines else []),
    )
    state = checkpoint(state)
    for _ in range(state.count().bit_length() + 1):
        moving = state.where(~F.col("done"))
        if moving.isEmpty():
            break
        step = state.select("grp", *[F.col(c).alias(f"{c}2") for c in state.columns if c not in ("grp", "node")], F.col("node").alias("far"))
        met = looked_up(moving, step, ["grp", "far"], None if lines else hot_keys(moving, ["grp", "far"], hot_rows))
        moved = met.select(
            "grp", "node", F.col("far2").alias("far"), (F.col("depth") + F.col("depth2")).alias("depth"), F.least("low", "low2").alias("low"),
            F.col("done2").alias("done"), *([F.concat("line", "line2").alias("line")] if lines else []),
        )
        last, state = state, checkpoint(state.where("done").unionByName(moved))
        dropped(last)
    return state


def toured(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """grp, node, first, last of links (grp, node, parent; null for none) without cycles, as a depth-first walk numbers them.

    The walk's tour is a list: entering a node leads to entering its first child or to leaving it, leaving it to entering
    the next sibling or to leaving its parent. Ranks in the list come from jumps along it; a node entered at place p and
    left at q has (q - p - 1) / 2 nodes below it, and (p + depth) / 2 nodes entered before it.
    """
    below = rows.where(F.col("parent").isNotNull())
    kids = checkpoint(ranked(below, ["grp", "parent"], [F.col("node").asc()], "n", hot_rows).select("grp", "parent", "node", "n"))
    ins, outs = F.concat(F.lit("i"), F.col("node")), F.concat(F.lit("o"), F.col("node"))
    eldest = kids.where("n = 1").select("grp", F.col("parent").alias("node"), F.col("node").alias("child"))
    enter = rows.select("grp", "node").join(eldest, ["grp", "node"], "left").select("grp", ins.alias("node"), F.when(F.col("child").isNotNull(), F.concat(F.lit("i"), "child")).otherwise(outs).alias("parent"))
    older = kids.select("grp", "parent", (F.col("n") - 1).alias("n"), F.col("node").alias("younger"))
    leave = kids.join(older, ["grp", "parent", "n"], "left").select("grp", outs.alias("node"), F.when(F.col("younger").isNotNull(), F.concat(F.lit("i"), "younger")).otherwise(F.concat(F.lit("o"), "parent")).alias("parent"))
    ends = rows.where(F.col("parent").isNull()).select("grp", outs.alias("node"), F.lit(None).cast("string").alias("parent"))
    places = jumped(enter.unionByName(leave).unionByName(ends), hot_rows=hot_rows)
    sides = places.groupBy("grp", F.substring("node", 2, 2_147_483_647).alias("node")).agg(
        F.max(F.when(F.col("node").startswith("i"), F.col("depth"))).alias("p"), F.max(F.when(F.col("node").startswith("o"), F.col("depth"))).alias("q"), F.max("far").alias("tail")
    )
    depths = jumped(rows, hot_rows=hot_rows).select("grp", "node", F.col("far").alias("top"), "depth")
    whole = sides.join(depths, ["grp", "node"])
    tops = checkpoint(whole.where("depth = 0").select("grp", "top", F.col("p").alias("length")))
    whole = looked_up(whole, tops, ["grp", "top"], hot_keys(whole, ["grp", "top"], hot_rows))
    first = ((F.col("length") - F.col("p") + F.col("depth")) / 2).cast("bigint")
    return whole.select("grp", "node", first.alias("first"), (first + ((F.col("p") - F.col("q") - 1) / 2).cast("bigint")).alias("last"))


def hierarchies(rows: DataFrame, more: tuple[str, ...] = (), bound: int = BOUND) -> DataFrame:
    """grp, node, root, depth of each link (grp, node, parent), and of `more`:

    path (array from the root to the node), children (n_descendants; null on cycles), interval (top, where the walk of its component begins, first and last), back (back_edge: the link that closes a cycle).
    """
    sizes = rows.groupBy("grp").count()
    large = checkpoint(sizes.where(F.col("count") > bound).select("grp"))
    if large.isEmpty():
        return _gathered(rows, ["grp"], more, "grp")
    flagged = with_hot(rows, large, ["grp"], F.lit(1), "large")
    small = _gathered(flagged.where("large is null"), ["grp"], more, "grp")
    return small.unionByName(_large(flagged.where("large is not null").drop("large"), more, bound))


def _large(rows: DataFrame, more: tuple[str, ...], bound: int) -> DataFrame:
    ends = jumped(rows)
    cycles = ends.where(~F.col("done")).select("grp", F.col("far").alias("node")).distinct().join(ends.select("grp", "node", "low"), ["grp", "node"])
    cycles = cycles.select("grp", F.col("node").alias("far"), F.col("low").alias("least"))
    placed = rows.join(ends.select("grp", "node", "far", "depth", "done"), ["grp", "node"])
    placed = looked_up(placed, cycles, ["grp", "far"], hot_keys(ends, ["grp", "far"]), "left")
    placed = checkpoint(placed.withColumn("comp", F.when(F.col("done"), F.col("far")).otherwise(F.col("least"))))
    huge = checkpoint(placed.groupBy("grp", "comp").count().where(F.col("count") > bound).select("grp", "comp"))
    marked = with_hot(placed, huge, ["grp", "comp"], F.lit(1), "huge")
    walked = _gathered(marked.where("huge is null"), ["grp", "comp"], more, "grp")
    rest = marked.where("huge is not null")
    tree = F.col("done")
    columns = ["grp", "node", F.when(tree, F.col("comp")).otherwise("").alias("root"), F.when(tree, F.col("depth")).otherwise(-1).alias("depth")]
    there = F.col("parent")  # a parent that is no node of the group makes a root
    opened = rest.select("grp", "node", F.when(F.when(tree, F.col("node") != F.col("far")).otherwise(F.col("node") != F.col("comp")), there).alias("parent"))
    if "path" in more:
        rest = rest.join(jumped(opened, lines=True).select("grp", "node", F.reverse("line").alias("line")), ["grp", "node"])
    if {"children", "interval"} & {*more}:
        rest = rest.join(toured(opened), ["grp", "node"])
    for m in more:
        if m == "path":
            columns.append(F.concat("line", F.array("node")).alias("path"))
        elif m == "children":
            columns.append(F.when(tree, F.col("last") - F.col("first")).alias("n_descendants"))
        elif m == "interval":
            columns += [F.col("comp").alias("top"), "first", "last"]
        else:
            columns.append((~tree & (F.col("node") == F.col("comp"))).alias("back_edge"))
    return walked.unionByName(rest.select(*columns))


def descendants(rows: DataFrame, bound: int = BOUND) -> DataFrame:
    """grp, ancestor, node, distance, written out: every node with every node above it; nodes on or above cycles have none.

    For trees that are not deep; the ranges of `hierarchies` say the same in one row a node.
    """
    tree = hierarchies(rows, ("path",), bound).where("depth > 0")
    above = tree.select("grp", "node", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("i", "ancestor"))
    return above.select("grp", "ancestor", "node", (F.col("depth") - F.col("i")).cast("bigint").alias("distance"))


def block_links(blocks: DataFrame) -> DataFrame:
    return links(blocks, "version_id", "block_id", "parent_block_id", "loaded_at")


def block_roots(blocks: DataFrame, bound: int = BOUND) -> DataFrame:
    """version_id, block_id, root_block_id, depth of every block."""
    return hierarchies(block_links(blocks), (), bound).select(
        F.col("grp").alias("version_id"), F.col("node").alias("block_id"), F.col("root").alias("root_block_id"), "depth"
    )
