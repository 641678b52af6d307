"""Which definition a call means: a cascade of tiers over joins, of which the first that finds anything wins.

Definitions are (node_id, name, file, package, node_ord, type), call sites (caller, name, file, package). What the nearer
tiers find is one definition. What only the name or a dynamic call finds is all definitions of the name: such a call
stays one row with their number (target null) until `expanded` gives it a row for each, so counts never need the pairs.

How a language looks for functions is a column, strategy: file (in the file, then imports), package (in the package, then
imports), global (imports only) or null for languages without rules, whose calls are resolved by name alone.

Defined cases: a call of a name without definitions has no row, unless an import names another; a null name, file or
package matches nothing; of several definitions the one with the least node_ord is first; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More candidates than this make a match by name ambiguous.
FANOUT_LIMIT = 3


def name_index(definitions: DataFrame) -> DataFrame:
    """Of every name how many definitions it has, and the first."""
    return definitions.groupBy("name").agg(F.count("*").alias("n_candidates"), F.min_by("node_id", "node_ord").alias("first_node"))


def _first(definitions: DataFrame, keys: list[str], out: str) -> DataFrame:
    return definitions.groupBy(*keys).agg(F.min_by("node_id", "node_ord").alias(out))


def by_scope(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """in_file and in_package: the first definition of the name in the call's file and in its package."""
    return calls.join(_first(definitions, ["name", "file"], "in_file"), ["name", "file"], "left").join(
        _first(definitions, ["name", "package"], "in_package"), ["name", "package"], "left"
    )


def by_alias(calls: DataFrame, aliases: DataFrame, definitions: DataFrame) -> DataFrame:
    """by_alias: the first definition of what the call's file imported under the name (aliases: file, alias, original)."""
    meant = aliases.select("file", F.col("alias").alias("name"), "original").join(
        _first(definitions, ["name"], "by_alias").withColumnRenamed("name", "original"), "original"
    )
    return calls.join(meant.drop("original"), ["file", "name"], "left")


def _by_name(calls: DataFrame, definitions: DataFrame, aliases: DataFrame | None, distinct: bool) -> DataFrame:
    """calls of a name with in_file, in_package, by_alias and n_candidates, as by_scope, by_alias and name_index give them.

    Joins by (name, file), (name, package) and name would move the calls three times. Here calls, definitions and aliases
    move once, to the partition of their name, where calls are made distinct if asked for and windows find the first of each.
    """
    nodes, own = dict(definitions.dtypes), dict(calls.dtypes)

    def marked(df: DataFrame, kind: str, node: str | None = None, order: str | None = None) -> DataFrame:
        spare = {c: F.lit(None).cast(t) for c, t in own.items() if c not in df.columns}
        marks = {"__kind": F.lit(kind), "__node": F.col(node) if node else F.lit(None).cast(nodes["node_id"]), "__ord": F.col(order) if order else F.lit(None).cast(nodes["node_ord"])}
        return df.where(F.col("name").isNotNull()).withColumns(spare | marks).select(*own, *marks)

    rows = marked(calls, "call").unionByName(marked(definitions.select("name", "file", "package", "node_id", "node_ord"), "definition", "node_id", "node_ord"))
    if aliases is not None:
        meant = aliases.select("file", F.col("alias").alias("name"), "original").join(_first(definitions, ["name"], "by_alias").withColumnRenamed("name", "original"), "original")
        rows = rows.unionByName(marked(meant.where("file is not null").select("file", "name", "by_alias"), "alias", "by_alias"))
    rows = rows.repartition("name")
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("__times")) if distinct else rows.withColumn("__times", F.lit(1).cast("bigint"))
    file, package, name = [Window.partitionBy("name", *k) for k in (["file"], ["package"], [])]
    defined, alias = F.col("__kind") == "definition", F.col("__kind") == "alias"
    first = F.min_by("__node", F.when(defined, F.col("__ord")))
    meanings = F.flatten(F.collect_list(F.when(alias, F.array_repeat("__node", F.col("__times").cast("int")))).over(file))
    met = rows.withColumns({"in_file": F.when(F.col("file").isNotNull(), first.over(file)), "__meant": meanings})
    met = met.withColumns({"in_package": F.when(F.col("package").isNotNull(), first.over(package)), "n_candidates": F.coalesce(F.sum(F.when(defined, F.col("__times"))).over(name), F.lit(0))})
    return met.where("__kind = 'call'").select(*own, "in_file", "in_package", "n_candidates", F.explode_outer("__meant").alias("by_alias"))


def resolve(calls: DataFrame, definitions: DataFrame, aliases: DataFrame | None = None, dynamic: F.Column | None = None, strategy: F.Column | None = None, distinct: bool = False) -> DataFrame:
    """Of every call site its target, resolution and number of candidates.

    Tiers: dynamic calls mean all candidates (skipped_dynamic), then the file or package (scope_rule), then imports
    (import_alias), then all candidates of the name (name_match, or name_match_ambiguous over FANOUT_LIMIT). target is
    null where all candidates are meant; strategy is by file if it isn't given. With distinct, calls that are alike count once.
    """
    met = _by_name(calls, definitions, aliases, distinct)
    how = strategy if strategy is not None else F.lit("file")
    scope = F.when(how == "file", F.col("in_file")).when(how == "package", F.col("in_package"))
    alias = F.when(how.isNotNull(), F.col("by_alias"))
    skipped = F.coalesce(dynamic if dynamic is not None else F.lit(False), F.lit(False)) & how.isNotNull()
    resolution = F.when(skipped, "skipped_dynamic").when(scope.isNotNull(), "scope_rule").when(alias.isNotNull(), "import_alias").when(
        F.col("n_candidates") > FANOUT_LIMIT, "name_match_ambiguous"
    ).otherwise("name_match")
    target = F.when(~skipped, F.coalesce(scope, alias))
    return met.select(*calls.columns, target.alias("target"), resolution.alias("resolution"), "n_candidates").where("target is not null or n_candidates > 0")


def expanded(resolved: DataFrame, definitions: DataFrame, name: str = "name") -> DataFrame:
    """resolved with a row for every definition that a call means."""
    single = resolved.where(F.col("target").isNotNull())
    every = definitions.select(F.col("name").alias(name), F.col("node_id").alias("__node"))
    many = resolved.where(F.col("target").isNull()).join(every, name)
    return single.unionByName(many.withColumn("target", F.col("__node")).select(*resolved.columns))


def _candidates(placed: DataFrame, definitions: DataFrame, keys: list[str], loops: bool) -> DataFrame:
    """keys..., target, n of the calls that mean all definitions of their name, which lie in the partition of their name."""
    many = placed.where(F.col("target").isNull()).groupBy(*keys).agg(F.count("*").alias("__calls"))
    every = definitions.repartition("name").groupBy("name", F.col("node_id").alias("target")).agg(F.count("*").alias("__times"))
    if loops:
        met = many.join(every, "name")
    else:  # the caller's text is made once, not for each pair
        met = many.withColumn("__self", F.col("caller").cast("string")).join(every, "name").where(F.col("__self") != F.col("target"))
    return met.select(*keys, "target", (F.col("__calls") * F.col("__times")).alias("n"))


def counted(resolved: DataFrame, definitions: DataFrame, keys: list[str], loops: bool = True) -> DataFrame:
    """keys..., target, n: how often `expanded` has each, for keys that hold the name and the resolution.

    Calls are counted before they get a row for each definition, and stay in the partition of their name, so the pairs,
    which may grow as the square of the input, are never moved. Without loops, those of a caller with itself are left out.
    """
    placed = resolved.repartition("name")
    single = placed.where(F.col("target").isNotNull()).groupBy(*keys, "target").agg(F.count("*").alias("n"))
    if not loops:
        single = single.where(F.col("caller").cast("string") != F.col("target"))
    return single.unionByName(_candidates(placed, definitions, keys, loops))


def _families(definitions: DataFrame) -> DataFrame:
    """node_id, family of the nodes that go by several names: those of the same names, each as often, are one family."""
    names = definitions.where("name is not null and node_id is not null").groupBy("node_id", "name").agg(F.count("*").alias("times"))
    digest = F.md5(F.concat_ws(" ", F.col("times").cast("string"), "name"))
    halves = [F.bit_xor(F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")).alias(f"h{at}") for at in (1, 16)]
    return names.groupBy("node_id").agg(F.count("*").alias("of"), *halves).where("of > 1").select("node_id", F.struct("of", "h1", "h16").alias("family"))


def edge_counts(resolved: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """`call_edges` of all that calls mean, each once with n, how often it occurs.

    A node that goes by several names, its own or imported ones, gets the sum over its names. Calls with one target are then
    added up by it; calls that mean all candidates are added up by family (`_families`) before they get a row for each
    node. Pairs with nodes of one name stay where they are, whatever other nodes have.
    """
    def edges(found: DataFrame) -> DataFrame:
        return found.select(F.col("caller").alias("from_node"), F.col("target").alias("to_node"), F.lit("calls").alias("type"), "resolution", "n")

    keys = ["caller", "name", "resolution"]
    named = definitions.groupBy("node_id").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    if named.isEmpty() and aliases.where("alias <> original").isEmpty():
        return edges(counted(resolved, definitions, keys, loops=False))
    placed, other = resolved.repartition("name"), F.col("caller").cast("string") != F.col("target")
    single = placed.where(F.col("target").isNotNull() & other).groupBy("caller", "target", "resolution").agg(F.count("*").alias("n"))
    nodes = _families(definitions)
    lone = _candidates(placed, definitions.join(nodes, "node_id", "left_anti"), keys, loops=False)
    parts = definitions.join(nodes, "node_id").groupBy("node_id", "name", "family").agg(F.count("*").alias("__times")).select("name", "family", "__times").distinct()
    many = placed.where(F.col("target").isNull()).groupBy(*keys).agg(F.count("*").alias("__calls")).join(parts, "name")
    sums = many.groupBy("caller", "resolution", "family").agg(F.sum(F.col("__calls") * F.col("__times")).alias("n"))
    several = sums.join(nodes.withColumnRenamed("node_id", "target"), "family").where(other)
    return edges(single).unionByName(edges(lone)).unionByName(edges(several))


def receivers(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls of a method on a class (receiver, method): the definition that is named `receiver.method` in its node id, else the first of the method in a file that defines the class.

    Only the classes and methods asked for are joined, never a file with itself.
    """
    bare = F.substring_index("node_id", "::", -1)
    exact = definitions.groupBy(bare.alias("full"), F.col("name").alias("method")).agg(F.min_by("node_id", "node_ord").alias("exact"))
    homes = definitions.where("type = 'class'").select("file", F.col("name").alias("receiver")).distinct()
    firsts = definitions.groupBy(F.col("name").alias("method"), "file").agg(F.min(F.struct("node_ord", "node_id")).alias("first"))
    wanted = calls.select("receiver", "method").distinct()
    near = wanted.join(homes, "receiver").join(firsts, ["method", "file"]).groupBy("receiver", "method").agg(F.min("first").getField("node_id").alias("near"))
    met = calls.withColumn("full", F.concat_ws(".", "receiver", "method")).join(exact, ["full", "method"], "left").join(near, ["receiver", "method"], "left")
    return met.select(*calls.columns, F.coalesce("exact", "near").alias("target"))


def extends_edges(classes: DataFrame, definitions: DataFrame, aliases: DataFrame | None = None, strategy: F.Column | None = None) -> DataFrame:
    """Edges from classes (node_id, file, package, bases) to what their bases resolve to; a dotted base counts by its last part."""
    sites = classes.select(F.col("node_id").alias("caller"), F.explode(F.transform("bases", lambda b: F.substring_index(b, ".", -1))).alias("name"), "file", "package", *[c for c in classes.columns if c == "language"]).distinct()
    found = expanded(resolve(sites, definitions, aliases, None, strategy), definitions)
    return call_edges(found).withColumn("type", F.lit("extends"))


def resolve_receivers(calls: DataFrame, definitions: DataFrame, aliases: DataFrame, dynamic: F.Column | None = None, strategy: F.Column | None = None) -> DataFrame:
    """Calls (caller, receiver, method, file, package, caller_class) as `resolve` gives them, with what is called on.

    A call on self or this in a method, or on a class of the file, means the first definition of the method in the file;
    one on an imported name the method of that class (`receivers`). Calls that find nothing so, or have no receiver, are
    resolved by their bare name. Dynamic calls mean all candidates, whatever they are called on.
    """
    ruled = strategy if strategy is not None else F.lit("file")
    skipped = F.coalesce(dynamic if dynamic is not None else F.lit(False), F.lit(False)) & ruled.isNotNull()
    base = calls.withColumns({"__skip": skipped, "__ruled": ruled.isNotNull()})
    here = _first(definitions.withColumnRenamed("name", "method"), ["method", "file"], "in_file")
    local = definitions.where("type = 'class'").select("file", F.col("name").alias("receiver"), F.lit(True).alias("local")).distinct()
    met = base.join(here, ["method", "file"], "left").join(local, ["file", "receiver"], "left")
    met = met.join(aliases.select("file", F.col("alias").alias("receiver"), "original"), ["file", "receiver"], "left")
    far = receivers(met.where(F.col("original").isNotNull()).select(F.col("original").alias("receiver"), "method").distinct(), definitions)
    met = met.join(far.select(F.col("receiver").alias("original"), "method", F.col("target").alias("far")), ["original", "method"], "left")
    own = F.col("receiver").isin("self", "this") & F.col("caller_class").isNotNull()
    kind = F.when(F.col("__skip") | F.col("receiver").isNull(), None).when(own, "file").when(F.col("local"), "file").when(F.col("__ruled") & F.col("original").isNotNull(), "far")
    hit = F.when(kind == "file", F.col("in_file")).when(kind == "far", F.col("far"))
    met = met.select(*calls.columns, hit.alias("__hit"), F.when(kind == "file", "scope_rule").when(kind == "far", "import_alias").alias("__how"))
    direct = met.where(F.col("__hit").isNotNull()).select(*calls.columns, F.col("__hit").alias("target"), F.col("__how").alias("resolution"), F.lit(1).cast("bigint").alias("n_candidates"))
    bare = met.where(F.col("__hit").isNull()).select(*calls.columns, F.col("method").alias("name"))
    return direct.unionByName(resolve(bare, definitions, aliases, dynamic, strategy).select(*calls.columns, "target", "resolution", "n_candidates"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """Edges from callers to their targets, without those to themselves."""
    return resolved.where(F.col("target").isNotNull() & (F.col("caller").cast("string") != F.col("target"))).select(
        F.col("caller").alias("from_node"), F.col("target").alias("to_node"), F.lit("calls").alias("type"), "resolution"
    )


def import_edges(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """Imports (file, name): from the first node of the importing file to every node of the name in another file."""
    source = _first(definitions, ["file"], "from_node")
    targets = definitions.select("name", F.col("node_id").alias("to_node"), F.col("file").alias("other"))
    met = imports.join(targets, "name").where(F.col("file") != F.col("other")).join(source, "file")
    return met.select("from_node", "to_node", F.lit("imports").alias("type")).distinct()


def first_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge of each (from_node, to_node, type): the first in order."""
    rest = [c for c in edges.columns if c not in ("from_node", "to_node", "type")]
    best = edges.groupBy("from_node", "to_node", "type").agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r"), F.count("*").alias("n_parallel"))
    return best.select("from_node", "to_node", "type", *[F.col(f"r.{c}").alias(c) for c in rest], "n_parallel")


def disambiguated(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """node_id made unique in its group: the second of an id gets #2, the third #3, with collided to warn of it."""
    line = Window.partitionBy(*keys, "node_id").orderBy(*order)
    numbered = nodes.withColumn("n", F.row_number().over(line))
    return numbered.withColumn("unique_id", F.when(F.col("n") > 1, F.concat("node_id", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("node_id"))).withColumn("collided", F.col("n") > 1).drop("n")
