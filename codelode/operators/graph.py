"""Graph queries over edges(src, dst, rel_type) and nodes(id, name, qualified_name, kind, visibility).

Paths are trails: an edge occurs at most once in a path.  Every step is a join of
the frontier with the edges.  Calls are walked to a bounded depth; cycles without a length, inheritance and contents are
followed to their end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators.retrieval import clamp
from codelode.operators.tables import kept
from codelode.schema import EXTRA_LABELS, RENAMED_LABELS

DEPTH, MOST_DEPTH, MOST_CYCLES = 3, 10, 100


def labels(kind: Column) -> Column:
    """Labels of a node: Entity, its kind (impl blocks by another name), and a second one for structs and traits."""
    own = kind
    for old, new in RENAMED_LABELS.items():
        own = F.when(kind == old, new).otherwise(own)
    extra = F.lit(None).cast("string")
    for old, new in EXTRA_LABELS.items():
        extra = F.when(kind == old, new).otherwise(extra)
    return F.array_compact(F.array(F.lit("Entity"), own, extra))


def of_type(edges: DataFrame, rel_type: str) -> DataFrame:
    return edges.filter(F.col("rel_type") == rel_type).select("src", "dst").distinct()


def _near(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """The edges a, b whose beginning lies within `depth - 1` edges of the start."""
    level = start.select(F.col("id").alias("node")).distinct()
    reached = [level]
    for _ in range(depth - 1):
        level = level.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        reached.append(level)
    return steps.join(reduce(DataFrame.union, reached).distinct(), F.col("a") == F.col("node"), "left_semi")


def _on_cycles(near: DataFrame, depth: int) -> DataFrame:
    """The edges of `near` that a walk of `depth` edges may meet twice, and perhaps a few more.

    Such an edge lies on a cycle of fewer edges than the walk: for three edges on one of at
    most two, for more on any; edges that nothing leads to or from are peeled off in turn."""
    if depth <= 3:
        other = near.select(F.col("a").alias("c"), F.col("b").alias("d"))
        return near.join(other, (F.col("a") == F.col("d")) & (F.col("b") == F.col("c")), "left_semi")
    left, n = near, near.count()
    for _ in range(depth):
        ends, begins = left.select(F.col("b").alias("x")).distinct(), left.select(F.col("a").alias("y")).distinct()
        left = kept(left.join(ends, F.col("a") == F.col("x"), "left_semi").join(begins, F.col("b") == F.col("y"), "left_semi"))
        n, before = left.count(), n
        if n in (0, before):
            break
    return left


def trails(edges: DataFrame, start: DataFrame, depth: int, back: bool = False) -> DataFrame:
    """origin, node, depth, each once, of every trail of 1 to `depth` edges from start(id); back: against the edges.

    A path remembers only edges that it could meet again, and paths that end alike and remember
    the same are one.  So where calls have no cycles, the cost follows the nodes, not the paths."""
    a, b = ("dst", "src") if back else ("src", "dst")
    steps = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    near = kept(_near(steps, start, depth))
    if depth > 1:
        again = _on_cycles(near, depth).select(F.col("a").alias("c"), F.col("b").alias("d"), F.lit(True).alias("again"))
        near = near.join(again, (F.col("a") == F.col("c")) & (F.col("b") == F.col("d")), "left").select("a", "b", F.coalesce("again", F.lit(False)).alias("again"))
    else:
        near = near.withColumn("again", F.lit(False))
    kind = start.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<a:{kind},b:{kind}>>")
    now = start.select(F.col("id").alias("origin"), F.col("id").alias("node"), none.alias("path")).distinct()
    levels = []
    for d in range(1, depth + 1):
        edge = F.struct("a", "b")
        met = now.join(near, F.col("node") == F.col("a")).filter(~F.col("again") | ~F.array_contains("path", edge))
        now = met.select("origin", F.col("b").alias("node"), F.when(F.col("again"), F.array_sort(F.array_append("path", edge))).otherwise(F.col("path")).alias("path")).distinct()
        levels.append(now.select("origin", "node", F.lit(d).alias("depth")))
    return reduce(DataFrame.union, levels).distinct()


def closure(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """origin, node of every node that start(id) reaches by an edge or more (and at most `depth`, if given); runs a job for each level."""
    steps = kept(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    new = start.select(F.col("id").alias("origin"), F.col("id").alias("node")).distinct()
    seen, level = new.limit(0), 0
    while depth is None or level < depth:
        new = new.join(steps, F.col("node") == F.col("a")).select("origin", F.col("b").alias("node")).distinct()
        new = kept(new.join(seen, ["origin", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen, level = seen.union(new), level + 1
        if level % 10 == 0:  # a short plan, however deep
            seen = kept(seen.coalesce(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return seen


def _found(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select(F.col("id").alias("node"), "qualified_name")
    return paths.select("node", "depth").distinct().join(names, "node").select("qualified_name", "depth").distinct().orderBy("depth", "qualified_name")


def callers(edges: DataFrame, nodes: DataFrame, qualified: str, depth: int = DEPTH) -> DataFrame:
    """qualified_name, depth of everything that calls it within `depth` calls, nearest first; a name may be at several depths."""
    start = nodes.filter(F.col("qualified_name") == qualified).select("id")
    return _found(trails(of_type(edges, "CALLS"), start, clamp(depth, 1, MOST_DEPTH), back=True), nodes)


def callees(edges: DataFrame, nodes: DataFrame, qualified: str, depth: int = DEPTH) -> DataFrame:
    start = nodes.filter(F.col("qualified_name") == qualified).select("id")
    return _found(trails(of_type(edges, "CALLS"), start, clamp(depth, 1, MOST_DEPTH)), nodes)


def named(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of a qualified name; where there is none, of a simple name."""
    both = nodes.filter((F.col("qualified_name") == name) | (F.col("name") == name)).withColumn("exact", F.col("qualified_name") == name)
    best = both.agg(F.max("exact").alias("any_exact"))
    return both.join(F.broadcast(best), both["exact"] == best["any_exact"]).drop("exact", "any_exact")


def implementations(edges: DataFrame, nodes: DataFrame, trait: str, direct: bool = True) -> DataFrame:
    """trait, type of every implementation: the type that an impl block is associated with, or (direct) the class itself."""
    target = named(nodes, trait).filter(F.col("kind").isin("Trait", "Interface")).select(F.col("id").alias("trait"), F.col("name").alias("trait_name"))
    kinds = nodes.select(F.col("id").alias("src"), "kind", F.col("name").alias("src_name"))
    impl = of_type(edges, "IMPLEMENTS").join(target, F.col("dst") == F.col("trait")).join(kinds, "src")
    of = of_type(edges, "ASSOCIATES").select(F.col("src").alias("block"), F.col("dst").alias("type_id"))
    names = nodes.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    by_block = impl.filter("kind = 'Impl'").join(of, F.col("src") == F.col("block")).join(names, "type_id").select("trait_name", "type_name")
    return by_block.union(impl.filter("kind <> 'Impl'").select("trait_name", F.col("src_name").alias("type_name"))) if direct else by_block


def hierarchy(edges: DataFrame, nodes: DataFrame, name: str, depth: int | None = None) -> DataFrame:
    """path: the simple names of every inheritance path of at least one edge (and at most `depth`, if given) from the class."""
    classes = nodes.filter(F.col("kind").isin("Class", "Struct")).select("id", "name")
    steps = of_type(edges, "INHERITS_FROM").join(classes.select(F.col("id").alias("dst"), F.col("name").alias("next")), "dst", "left")
    start = named(nodes, name).filter(F.col("kind").isin("Class", "Struct"))
    now = start.select(F.col("id").alias("node"), F.array("name").alias("path"), F.array("id").alias("ids"))
    steps, levels = kept(steps), []
    while depth is None or len(levels) < max(depth, 1):
        now = now.join(steps, F.col("node") == F.col("src")).filter(~F.array_contains("ids", F.col("dst")))
        now = kept(now.select(F.col("dst").alias("node"), F.array_append("path", F.col("next")).alias("path"), F.array_append("ids", F.col("dst")).alias("ids"), "next"))
        levels.append(now.filter("next IS NOT NULL").select("path"))
        if now.isEmpty():
            break
        now = now.drop("next")
    return reduce(DataFrame.union, levels)


def contents(edges: DataFrame, nodes: DataFrame, module: str, depth: int | None = None) -> DataFrame:
    """qualified_name of every function inside the module, however deep unless a depth is given."""
    start = nodes.filter((F.col("qualified_name") == module) & (F.col("kind") == "Module")).select("id")
    steps = of_type(edges, "CONTAINS")
    inside = closure(steps, start, depth).select(F.col("node").alias("id")).distinct()
    return nodes.filter("kind = 'Function'").join(inside, "id", "left_semi").select("qualified_name")


def dependencies(edges: DataFrame, nodes: DataFrame, module: str) -> DataFrame:
    """qualified_name of the modules that the module imports directly."""
    modules = nodes.filter("kind = 'Module'").select("id", "qualified_name")
    start = modules.filter(F.col("qualified_name") == module).select(F.col("id").alias("src"))
    return of_type(edges, "IMPORTS").join(start, "src", "left_semi").join(modules, F.col("dst") == F.col("id")).select("qualified_name").distinct()


def unused(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Private functions that no function or method calls, but for entry points and tests."""
    callers_ = nodes.filter(F.col("kind").isin("Function", "Method")).select(F.col("id").alias("src"))
    called = of_type(edges, "CALLS").join(callers_, "src", "left_semi").select(F.col("dst").alias("id"))
    private = nodes.filter((F.col("kind") == "Function") & (F.lower("visibility") == "private") & ~F.col("name").isin("main", "test") & ~F.startswith("name", F.lit("test_")))
    return private.join(called, "id", "left_anti").select("qualified_name")


def cycles(edges: DataFrame, nodes: DataFrame, length: int | None = None, canonical: bool = False, limit: int | None = MOST_CYCLES) -> DataFrame:
    """path (qualified names, first and last equal), length: import trails that return to a module through another one.

    A simple cycle of n modules gives n * (n - 1) rows in bag mode (start and middle module); canonical mode gives each once,
    beginning at its smallest name.  Without a length, trails within strongly connected modules are extended level by level
    until none is left or, as the shortest come first, `limit` rows are found."""
    names = nodes.select("id", "qualified_name")
    steps = of_type(edges, "IMPORTS").join(names.select(F.col("id").alias("src"), F.col("qualified_name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("qualified_name").alias("b")), "dst").select("a", "b").distinct()
    modules = nodes.filter("kind = 'Module'").select(F.col("qualified_name").alias("start"))
    edge = F.struct("a", "b")
    middle = modules.select(F.col("start").alias("mid"))

    def first(steps: DataFrame) -> DataFrame:
        return modules.join(steps, F.col("start") == F.col("a")).select("start", F.col("b").alias("node"), F.array(edge).alias("trail"))

    def extended(now: DataFrame, steps: DataFrame) -> DataFrame:
        return now.join(steps, F.col("node") == F.col("a")).filter(~F.array_contains("trail", edge)).select("start", F.col("b").alias("node"), F.array_append("trail", edge).alias("trail"))

    def reported(closed: DataFrame) -> DataFrame:
        path = F.concat(F.array("start"), F.transform("trail", lambda e: e["b"]))
        closed = closed.select(path.alias("path"), "length", "start", F.slice(F.transform("trail", lambda e: e["b"]), 1, F.col("length") - 1).alias("inner"))
        if canonical:
            return closed.filter((F.size("inner") > 0) & F.forall("inner", lambda x: x > F.col("start"))).select("path", "length")
        return closed.select("path", "length", "start", F.explode("inner").alias("mid")).filter("mid <> start").join(middle, "mid", "left_semi").select("path", "length")

    levels = []
    if length is not None and length <= MOST_DEPTH:
        now = first(steps)
        for n in range(1, max(length, 2) + 1):
            if n > 1:
                now = extended(now, steps)
            levels.append(now.filter("node = start").withColumn("length", F.lit(n)))
        found = reported(reduce(DataFrame.union, levels))
    else:
        reach = closure(steps.select(F.col("a").alias("src"), F.col("b").alias("dst")), steps.select(F.col("a").alias("id")))
        steps = kept(steps.join(reach, (F.col("b") == F.col("origin")) & (F.col("a") == F.col("node")), "left_semi"))
        now, n, many = first(steps), 1, 0
        while True:
            # a canonical trail never passes a name before its start, and ends there
            now = kept(now.filter("node >= start") if canonical else now)
            levels.append(kept(reported(now.filter("node = start").withColumn("length", F.lit(n)))))
            many += levels[-1].count()
            if n == length or (limit and many >= limit) or now.isEmpty():
                break
            now, n = extended(now.filter("node > start") if canonical else now, steps), n + 1
        found = reduce(DataFrame.union, levels)
    # by the path as it is written out: an order by its names one after another cuts other rows off
    return found.orderBy("length", F.array_join("path", ">")).limit(limit) if limit else found


def valid_edges(edges: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of known kinds whose ends both exist, each once."""
    ids = nodes.select(F.col("id").alias("end"))
    known = edges.filter(F.col("rel_type").isin(kinds))
    known = known.join(ids, known["src"] == F.col("end"), "left_semi").join(ids, F.col("dst") == F.col("end"), "left_semi")
    return known.dropDuplicates(["repository_id", "src", "dst", "rel_type"])


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after deleting gone(id) with all their edges."""
    ids = gone.select(F.col("id").alias("gone"))
    left = edges.join(ids, F.col("src") == F.col("gone"), "left_anti").join(ids, F.col("dst") == F.col("gone"), "left_anti")
    return nodes.join(ids, F.col("id") == F.col("gone"), "left_anti"), left
