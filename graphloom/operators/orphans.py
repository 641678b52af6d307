"""References to records that do not exist: keyed pending-orphan state, kept incrementally.

A parent is a key with lifetimes, a reference is a key with an arrival time. Both become events of their key. Folding a
key's events in order of time keeps two numbers, how many lifetimes are open and how many references are known:

* a reference that arrives probes the first number: none open makes it an orphan (opened),
* a parent that arrives while none is open resolves all references known so far,
* the end of the last open lifetime reopens them.

The state between two batches is that pair for each key; keys of which nothing is open or known are left out of it.
`advance` folds a batch of later events into it and gives the next state, the transitions and the references that
opened as orphans. Folding everything at once, or in any split by time, gives the same rows; `in_batches` writes the state
after each batch and reads it for the next. At one moment parents act before references, and a lifetime doesn't hold
its end.

Defined cases: a null key part equals a null key part; a reference without a time is an orphan of the period null, except
that relation ends, whose parents come with them, are probed all the same; a lifetime without a start, or not longer
than nothing, does not exist; repeated lifetimes count once or more often with the same effect; a reference that comes
again with the same name and moment counts once; empty tables give no rows; other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.skew import HOT_ROWS, hot_keys, is_blank, looked_up, neighbour, with_hot
from graphloom.session import checkpoint

KEY = ["space", "scope", "part", "item"]
EVENT = [*KEY, "at", "opened", "known", "name"]
#: Batches into which a stored table is split; any number gives the same rows.
BATCHES = 2
_START = "timestamp_ntz'0001-01-01 00:00:00'"
#: Stands for the time of outputs that have none, so that their ends meet their own features.
_TIMELESS = "timestamp_ntz'9999-12-31 23:59:59.999999'"
_UNKNOWN = object()


def parent_events(lifetimes: DataFrame) -> DataFrame:
    """Events of lifetimes (KEY, valid_from, valid_to): opened +1 at the start, -1 at the end."""
    lasting = lifetimes.where(F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
    ends = F.array(
        F.struct(F.col("valid_from").cast("timestamp_ntz").alias("at"), F.lit(1).alias("opened")),
        F.struct(F.col("valid_to").cast("timestamp_ntz").alias("at"), F.lit(-1).alias("opened")),
    )
    moments = lasting.select(*KEY, F.inline(ends)).where(F.col("at").isNotNull())
    return moments.withColumns({"known": F.lit(0), "name": F.lit(None).cast("string")}).select(*EVENT)


def reference_events(references: DataFrame) -> DataFrame:
    """Events of references (KEY, at, name): each makes one more known."""
    return references.withColumns({"at": F.col("at").cast("timestamp_ntz"), "opened": F.lit(0), "known": F.lit(1)}).select(*EVENT)


def advance(state: DataFrame | None, events: DataFrame, hot_rows: int = HOT_ROWS, hot: DataFrame | None | object = _UNKNOWN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold events (EVENT; later than all folded before) into the state.

    Gives the next state (KEY, opened, known), the transitions (KEY, at, arrived, orphaned, resolved, reopened), one row for
    each key and moment, and the references that opened as orphans (KEY, at, name). Events without a time are left out.
    """
    events = events.select(*EVENT).where(F.col("at").isNotNull())
    if hot is _UNKNOWN:
        hot = hot_keys(events, KEY, hot_rows)
    carried = F.lit(False)
    if state is not None:
        before = state.select(*KEY, F.expr(_START).alias("at"), "opened", "known", F.lit(None).cast("string").alias("name"))
        events, carried = events.unionByName(before), F.col("at") == F.expr(_START)
    events = with_hot(events.withColumn("carried", carried), hot, KEY, F.unix_seconds(F.date_trunc("MINUTE", F.col("at")).cast("timestamp")))
    cold, moving, opened = _fold(events.where(F.col("slice").isNull()).drop("slice"))
    if hot is not None:
        more = _fold_hot(events.where(F.col("slice").isNotNull()), hot_rows)
        cold, moving, opened = cold.unionByName(more[0]), moving.unionByName(more[1]), opened.unionByName(more[2])
    return cold.where("opened <> 0 or known <> 0"), moving, opened


def _moves(moments: DataFrame) -> DataFrame:
    """Transitions of moments (KEY, at, turn, arrived, after, total): what is open after them and known with them."""
    before, earlier, zero = F.col("after") - F.col("turn"), F.col("total") - F.col("arrived"), F.lit(0)
    gone, there = F.col("after") <= 0, F.col("after") > 0
    rows = moments.select(
        *KEY, "at", "arrived",
        F.when(gone, F.col("arrived")).otherwise(zero).alias("orphaned"),
        F.when(there & (before <= 0), earlier).otherwise(zero).alias("resolved"),
        F.when(gone & (before > 0), earlier).otherwise(zero).alias("reopened"),
    )
    return rows.where((F.col("arrived") > 0) | (F.col("resolved") > 0) | (F.col("reopened") > 0))


def _own(column: str) -> Column:
    return F.sum(F.when(~F.col("carried"), F.col(column)).otherwise(0))


def _fold(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State, transitions and orphans of keys that each fit a task: one shuffle by key serves all steps."""
    placed = events.repartition(*KEY)
    known = F.when(F.col("carried"), F.sum("known")).otherwise(F.max("known"))
    once = placed.groupBy(*KEY, "at", "carried", "name").agg(F.sum("opened").alias("opened"), known.alias("known"))
    so_far = Window.partitionBy(*KEY).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = once.withColumns({"after": F.sum("opened").over(so_far), "total": F.sum("known").over(so_far)})
    following = once.groupBy(*KEY).agg(F.sum("opened").alias("opened"), F.sum("known").alias("known"))
    moments = seen.groupBy(*KEY, "at").agg(_own("opened").alias("turn"), _own("known").alias("arrived"), F.max("after").alias("after"), F.max("total").alias("total"))
    orphans = seen.where((F.col("known") == 1) & ~F.col("carried") & (F.col("after") <= 0))
    return following, _moves(moments), orphans.select(*KEY, "at", "name")


def _fold_hot(events: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of keys with too many events for a task.

    References are made distinct over all of their columns and added up before the shuffle, so that a moment of a key is
    one row however many arrive at it. Moments are folded in slices of a minute, which begin with what the slices before
    add up to, and references look up what is open at their moment.
    """
    keys = F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}).alias("key")
    real = events.where(~F.col("carried"))
    once = real.where("known = 1").select(*KEY, "slice", "at", "name").distinct()
    turns = real.where("known = 0").select(*KEY, "slice", "at", "opened", F.lit(0).alias("known"))
    parts = turns.unionByName(once.select(*KEY, "slice", "at", F.lit(0).alias("opened"), F.lit(1).alias("known")))
    moments = parts.groupBy(*KEY, "slice", "at").agg(F.sum("opened").alias("turn"), F.sum("known").alias("arrived"))
    begins = events.where("carried").groupBy(*KEY).agg(F.sum("opened").alias("turn"), F.sum("known").alias("arrived"))
    sums = moments.groupBy(*KEY, "slice").agg(F.sum("turn").alias("turn"), F.sum("arrived").alias("arrived"))
    sums = sums.unionByName(begins.withColumn("slice", F.lit(None).cast("bigint")))  # null comes first
    before = Window.partitionBy(*KEY).orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*KEY, "slice", F.sum("turn").over(before).alias("o"), F.sum("arrived").over(before).alias("k"))
    starts = starts.where(F.col("slice").isNotNull()).select(keys, F.col("slice").alias("s"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("k", F.lit(0)).alias("k"))
    met = moments.withColumn("key", keys).join(starts.withColumnRenamed("s", "slice"), ["key", "slice"])
    line = Window.partitionBy("key", "slice").orderBy("at")
    met = met.withColumns({"after": F.sum("turn").over(line) + F.col("o"), "total": F.sum("arrived").over(line) + F.col("k")})
    met = checkpoint(met.select(*KEY, "key", "at", "turn", "arrived", "after", "total"))
    waiting = once.withColumn("key", keys)
    dead = met.where("after <= 0 and arrived > 0").select("key", "at")
    orphans = looked_up(waiting, dead, ["key", "at"], hot_keys(waiting, ["key", "at"], hot_rows))
    following = sums.groupBy(*KEY).agg(F.sum("turn").alias("opened"), F.sum("arrived").alias("known"))
    return following, _moves(met), orphans.select(*KEY, "at", "name")


def in_batches(events: DataFrame, batches: int = BATCHES, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Transitions and orphans of all events (EVENT), folded batch by batch with the state written in between.

    The events are made once and written; their times' quantiles bound the batches. References without a time are
    orphans of no moment and make no transition.
    """
    events = checkpoint(events)
    hot = hot_keys(events.where(F.col("at").isNotNull()), KEY, hot_rows)
    moment = F.unix_micros(F.col("at").cast("timestamp"))
    cuts = events.where("known = 1").select(moment.alias("t")).agg(F.percentile_approx("t", [i / batches for i in range(1, batches)] or [1.0], 100)).first()[0] or []
    bounds = [None, *sorted({*cuts[: batches - 1]}), None]
    state, moves, opened = None, [], [events.where("known = 1 and at is null").select(*KEY, "at", "name").distinct()]
    for low, high in zip(bounds, bounds[1:]):
        part = events
        if low is not None:
            part = part.where(moment > low)
        if high is not None:
            part = part.where(moment <= high)
        state, moving, orphans = advance(state, part, hot_rows, hot)
        moves.append(moving)
        opened.append(orphans)
        if high is not None:
            state = checkpoint(state)
    transitions, found = moves[0], opened[0]
    for more in moves[1:]:
        transitions = transitions.unionByName(more)
    for more in opened[1:]:
        found = found.unionByName(more)
    return transitions, found


def by_period(transitions: DataFrame) -> DataFrame:
    """Counts of each space and month from its first to its last, with the orphans that are pending at the month's end.

    Transitions without a time (period null) come first in the line.
    """
    counts = ("arrived", "orphaned", "resolved", "reopened")
    months = transitions.groupBy("space", F.trunc(F.col("at").cast("date"), "month").alias("month")).agg(*[F.sum(c).cast("bigint").alias(c) for c in counts])
    months = checkpoint(months)  # a row a month, read three times
    every = months.where(F.col("month").isNotNull()).groupBy("space").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = every.select("space", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    empty = every.join(months.select("space", "month"), ["space", "month"], "left_anti")
    whole = months.unionByName(empty.select("space", "month", *[F.lit(0).cast("bigint").alias(c) for c in counts]))
    line = Window.partitionBy("space").orderBy(F.col("month").asc_nulls_first())  # a row a month
    pending = F.sum(F.col("orphaned") + F.col("reopened") - F.col("resolved")).over(line)
    return whole.select("space", F.date_format("month", "yyyy-MM").alias("period"), *counts, pending.cast("bigint").alias("pending"))


def _entries(c) -> Column:
    return F.array_distinct(F.filter(c, lambda x: ~is_blank(x)))


def _key(space: str, scope: str, part: str | None) -> list[Column]:
    return [F.lit(space).alias("space"), F.col(scope).alias("scope"), (F.col(part) if part else F.lit(None).cast("string")).alias("part")]


def node_lifetimes(nodes: DataFrame) -> DataFrame:
    """Nodes as parents of source_nodes."""
    return nodes.select(*_key("source_nodes", "project_id", None), F.col("node_id").alias("item"), F.col("created_at").alias("valid_from"), F.col("removed_at").alias("valid_to"))


def feature_lifetimes(l1: DataFrame) -> DataFrame:
    """Features as parents of related_features: alive from their output to the next one of the project's version."""
    slim = l1.where(F.col("produced_at").isNotNull()).groupBy("project_id", "version_id", "produced_at").agg(F.max("output_id").alias("output_id"))
    slim = neighbour(slim, ["project_id", "version_id"], ["produced_at"], "produced_at", "until", back=False)
    ids = F.array_distinct(F.transform(F.coalesce(F.col("l1.features"), F.array()), lambda f: f["feature_id"]))
    features = l1.select("output_id", "produced_at", ids.alias("ids"))
    kept = slim.withColumnsRenamed({"output_id": "o", "produced_at": "p"})
    rows = features.join(kept, F.col("output_id").eqNullSafe(F.col("o")) & (F.col("produced_at") == F.col("p")))
    return rows.select(
        *_key("related_features", "project_id", "version_id"), F.explode("ids").alias("item"), F.col("p").alias("valid_from"), F.col("until").alias("valid_to"),
    ).where(F.col("item").isNotNull())


def _node_references(l1: DataFrame) -> DataFrame:
    nodes = F.flatten(F.transform(F.filter("l1.features", lambda f: f["source_nodes"].isNotNull()), lambda f: f["source_nodes"]))
    return l1.select(*_key("source_nodes", "project_id", None), F.explode(_entries(nodes)).alias("item"), F.col("produced_at").alias("at"), F.col("output_id").alias("name"))


def _feature_references(l15: DataFrame) -> DataFrame:
    related = F.flatten(F.transform(F.filter("l1_5.blocks", lambda b: b["related_features"].isNotNull()), lambda b: b["related_features"]))
    return l15.select(*_key("related_features", "project_id", "version_id"), F.explode(_entries(related)).alias("item"), F.col("produced_at").alias("at"), F.col("output_id").alias("name"))


def relation_events(l1: DataFrame) -> DataFrame:
    """Features as parents of the relation ends of their own output, and these ends; both are there from its moment on."""
    features = F.array_distinct(F.filter(F.transform("l1.features", lambda f: f["feature_id"]), lambda x: x.isNotNull()))

    def events(space: str, known: int, entries: Column) -> Column:
        return F.transform(entries, lambda x: F.struct(F.lit(space).alias("space"), x.alias("item"), F.lit(1 - known).alias("opened"), F.lit(known).alias("known")))

    def ends(side: str) -> Column:
        return _entries(F.transform("l1.feature_relations", lambda r: r[side]))

    kinds = [events("from", 0, features), events("to", 0, features), events("from", 1, ends("from")), events("to", 1, ends("to"))]
    nothing = F.array().cast("array<struct<space: string, item: string, opened: int, known: int>>")
    rows = l1.select("output_id", F.coalesce(F.col("produced_at").cast("timestamp_ntz"), F.expr(_TIMELESS)).alias("at"), F.inline(F.concat(*[F.coalesce(k, nothing) for k in kinds])))
    return rows.select(
        "space", F.col("output_id").alias("scope"), F.lit(None).cast("string").alias("part"), "item", "at", "opened", "known",
        F.when(F.col("known") == 1, F.col("output_id")).alias("name"),
    )


def output_events(l1: DataFrame, l15: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parents and references of all four kinds as events."""
    parents = parent_events(node_lifetimes(nodes).unionByName(feature_lifetimes(l1)))
    references = reference_events(_node_references(l1).unionByName(_feature_references(l15)))
    return parents.unionByName(references).unionByName(relation_events(l1))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.when(F.col("at") != F.expr(_TIMELESS), F.col("at")))


def orphan_references(l1: DataFrame, l15: DataFrame, nodes: DataFrame, hot_rows: int = HOT_ROWS, batches: int = BATCHES) -> DataFrame:
    """Every reference of the outputs that does not hold: output_id, ref_field, ref_key, period (month of produced_at).

    Outputs delivered again count once. Of several L1 outputs of a version at one moment the one with the greatest
    output_id holds.
    """
    _, found = in_batches(output_events(l1, l15, nodes), batches, hot_rows)
    return _timed(found).select(
        F.col("name").alias("output_id"), F.col("space").alias("ref_field"), F.col("item").alias("ref_key"), F.date_format("at", "yyyy-MM").alias("period")
    ).distinct()


def orphan_report(l1: DataFrame, l15: DataFrame, nodes: DataFrame, hot_rows: int = HOT_ROWS, batches: int = BATCHES) -> DataFrame:
    """For each kind of reference and month: references arrived, orphaned, resolved, reopened, and pending at its end.

    Outputs delivered again count once. References without a time are counted in the period null, which comes first in
    the line; those that are orphans stay pending.
    """
    transitions, found = in_batches(output_events(l1, l15, nodes), batches, hot_rows)
    columns = ["space", "at", "arrived", "orphaned", "resolved", "reopened"]
    one, none = F.lit(1), F.lit(0)
    timeless = found.where(F.col("at").isNull()).select("space", "at", one.alias("arrived"), one.alias("orphaned"), none.alias("resolved"), none.alias("reopened"))
    return by_period(_timed(transitions.select(*columns)).unionByName(timeless))
