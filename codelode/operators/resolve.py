"""Reference resolution: one cascade of equi-joins over all references, first strategy that hits wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import external_name, external_package, simple_name
from codelode.operators.tables import kept

#: Names that are broadcast to the references once they are resolved; more are met in a join.
BROADCAST_NAMES = 100_000

# Strategies of each relation in their order, and what it may point to.
STRATEGIES = {
    "CALLS": ["qualified", "alias", "unique", "simple"],
    "USES": ["qualified", "simple"],
    "IMPLEMENTS": ["qualified", "simple"],
    "ASSOCIATES": ["qualified"],
    "EXTENDS_INTERFACE": ["qualified", "simple"],
    "INHERITS_FROM": ["qualified", "simple"],
    "IMPORTS": ["qualified", "path", "simple"],
    "REEXPORTS": ["qualified", "path", "simple"],
}
TYPES = ["Struct", "Enum", "Class", "Interface", "Trait", "TypeAlias"]
ITEMS = ["Function", "Struct", "Enum", "Class", "Interface", "Trait", "TypeAlias", "Module", "Constant"]
TARGETS = {
    "CALLS": ["Function", "Method"],
    "USES": TYPES,
    "IMPLEMENTS": ["Trait", "Interface"],
    "ASSOCIATES": TYPES,
    "EXTENDS_INTERFACE": ["Trait", "Interface"],
    "INHERITS_FROM": ["Class"],
    "IMPORTS": ITEMS,
    "REEXPORTS": ITEMS,
}
#: Reference field of an entity for each relation.
FIELDS = {"CALLS": "calls", "USES": "uses_types", "IMPLEMENTS": "implements", "EXTENDS_INTERFACE": "extended_types", "INHERITS_FROM": "extends", "IMPORTS": "imports", "REEXPORTS": "reexports"}


def contains_edges(entities: DataFrame) -> DataFrame:
    """repository_id, src, dst, rel_type: parent_scope names the parent; of equal names the smallest id is the parent."""
    parents = entities.groupBy("repository_id", F.col("qualified_name").alias("parent_scope")).agg(F.min("entity_id").alias("src"))
    rows = entities.select("repository_id", "parent_scope", F.col("entity_id").alias("dst")).join(parents, ["repository_id", "parent_scope"])
    return rows.filter("src <> dst").select("repository_id", "src", "dst", F.lit("CONTAINS").alias("rel_type"))


def references(entities: DataFrame) -> DataFrame:
    """repository_id, src, rel_type, target, simple, is_external: all references of all relations, from one scan."""
    fields = entities.schema["relationships"].dataType.names
    lists = {rel: F.col(f"relationships.{field}") for rel, field in FIELDS.items()}
    none = F.array().cast(entities.schema["relationships"].dataType["calls"].dataType)
    one = lambda field: F.array_compact(F.array(f"relationships.{field}")) if field in fields else none
    lists["IMPLEMENTS"] = F.concat(one("implements_trait"), F.coalesce(lists["IMPLEMENTS"], none))
    lists["ASSOCIATES"] = one("for_type")
    tag = lambda rel, refs: F.transform(F.coalesce(refs, none), lambda r: F.struct(F.lit(rel).alias("rel_type"), r.alias("ref")))
    tagged = [tag(rel, refs) for rel, refs in lists.items()]
    rows = entities.select("repository_id", F.col("entity_id").alias("src"), F.explode(F.concat(*tagged)).alias("x"))
    return rows.select("repository_id", "src", "x.rel_type", F.col("x.ref.target").alias("target"), F.coalesce("x.ref.simple_name", simple_name(F.col("x.ref.target"))).alias("simple"), F.coalesce("x.ref.is_external", F.lit(False)).alias("is_external"))


def _targets(entities: DataFrame) -> DataFrame:
    """rel_type, how, key, dst, one row per key: every way to reach a target.

    Each way is made unique by its key, so left joins never multiply references."""
    rows = entities.select("repository_id", "entity_id", "name", "qualified_name", "path_entity_identifier", "entity_type", F.col("relationships.call_aliases").alias("aliases"))
    allowed = F.array(*[F.struct(F.lit(rel).alias("rel_type"), F.array(*map(F.lit, kinds)).alias("kinds")) for rel, kinds in TARGETS.items()])
    rows = rows.select("*", F.explode(F.filter(allowed, lambda a: F.array_contains(a["kinds"], F.col("entity_type")))).alias("a")).select("*", "a.rel_type").drop("a")
    by = ["repository_id", "rel_type"]
    first = lambda df, how: df.groupBy(*by, "key").agg(F.min("entity_id").alias("dst")).withColumn("how", F.lit(how))
    qualified = first(rows.withColumn("key", F.col("qualified_name")), "qualified")
    path = first(rows.withColumn("key", F.col("path_entity_identifier")), "path")
    alias = first(rows.select(*by, "entity_id", F.explode("aliases").alias("key")), "alias")
    named = rows.groupBy(*by, F.col("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.startswith("qualified_name", F.lit("<")), "entity_id")).alias("best"))
    simple = named.select(*by, "key", F.col("best.entity_id").alias("dst"), F.lit("simple").alias("how"))
    unique = named.filter("n = 1").select(*by, "key", F.col("best.entity_id").alias("dst"), F.lit("unique").alias("how"))
    return reduce(lambda a, b: a.unionByName(b), [qualified, path, alias, simple, unique]).filter("key IS NOT NULL")


def resolve(entities: DataFrame, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, external nodes).  Local resolution comes before the external flag; self edges stay for calls only.

    All strategies go through one join: the cascade is the least place of a strategy that hit.  It depends on what is named and not on
    who names it, so every name is resolved once, however many references it has, and the references look theirs up."""
    refs = references(entities) if refs is None else refs
    order = F.create_map(*[x for rel, hows in STRATEGIES.items() for x in (F.lit(rel), F.array(*map(F.lit, hows)))])
    by = ["repository_id", "rel_type", "target", "simple"]
    tries = refs.select(*by).distinct().select("*", F.posexplode(order[F.col("rel_type")]).alias("place", "how"))
    tries = tries.withColumn("key", F.when(F.col("how").isin("unique", "simple"), F.col("simple")).otherwise(F.col("target")))
    hits = tries.join(_targets(entities), ["repository_id", "rel_type", "how", "key"])
    best = hits.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(F.struct("place", "dst", "how")).alias("hit")).withColumn("hit", F.col("hit.dst"))
    best = kept(best)
    best = F.broadcast(best) if best.count() <= BROADCAST_NAMES else best
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    rows = refs.join(best, reduce(lambda a, b: a & b, same), "left")
    outside = F.col("hit").isNull() & F.col("is_external")
    local = F.col("hit").isNotNull() & ((F.col("src") != F.col("hit")) | (F.col("rel_type") == "CALLS"))
    edges = rows.filter(local | outside).select("repository_id", "src", F.coalesce("hit", external_name(F.col("target"))).alias("dst"), "rel_type").dropDuplicates()
    named = rows.filter(outside).select("repository_id", "target").distinct().select(external_name(F.col("target")).alias("id"), "repository_id", external_package(F.col("target")).alias("package"))
    nodes = named.select("id", "repository_id", F.col("id").alias("qualified_name"), F.element_at(F.split("id", "::"), -1).alias("name"), "package").dropDuplicates(["id", "repository_id"])
    return edges, nodes


def unique_names(entities: DataFrame, name: str = "name", key: str = "entity_id") -> DataFrame:
    """name, n, first: how many entities share a simple name, and the one where it is alone."""
    counts = entities.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    return counts.withColumn("unique_id", F.when(F.col("n") == 1, F.col("first")))


def longest_prefix(files: DataFrame, packages: DataFrame, path: str = "path", directory: str = "directory") -> DataFrame:
    """Each file with the package of the deepest directory above it (null if none).

    A file's own ancestors are exploded and joined by equality: no non-equi join, whatever the number of packages."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    rows = files.select(path, F.explode(ups).alias("up")).select(path, "up.depth", "up.dir")
    known = packages.select(F.col(directory).alias("dir"), *[c for c in packages.columns if c != directory])
    rank = F.row_number().over(Window.partitionBy(path).orderBy(F.desc("depth")))
    best = rows.join(known, "dir").withColumn("rank", rank).filter("rank = 1").drop("rank", "depth").withColumnRenamed("dir", directory)
    return files.select(path).distinct().join(best, path, "left")
