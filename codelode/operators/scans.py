"""Look-ups over entity, embedding, snapshot and repository tables, and whole-table steps of incremental indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.operators import ingest
from codelode.operators.resolve import TYPES
from codelode.operators.retrieval import DEFAULT_AVGDL


def by_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Live rows whose key is in `keys` (each once, however often it is asked for)."""
    rows = ingest.live(table) if "deleted_at" in table.columns else table
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def of_types(entities: DataFrame, kinds: list[str] | None = None, repository: str | None = None) -> DataFrame:
    """Live entities of the given kinds (by default all that are types), compared without case."""
    rows = ingest.live(entities).filter(F.lower("entity_type").isin([k.lower() for k in kinds or TYPES]))
    return rows if repository is None else rows.filter(F.col("repository_id") == repository)


def embeddings_of_names(entities: DataFrame, embeddings: DataFrame, names: DataFrame) -> DataFrame:
    """qualified_name, entity_id, embedding: inner join by embedding_id, for the names asked for."""
    rows = by_keys(entities, names, ["qualified_name"]).select("qualified_name", "entity_id", "embedding_id")
    return rows.join(embeddings.select(F.col("id").alias("embedding_id"), "embedding"), "embedding_id").drop("embedding_id")


def embeddings_by_ids(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """id, embedding, sparse_indices, sparse_values of the ids asked for (each once)."""
    return by_keys(embeddings, ids, ["id"]).select("id", "embedding", "sparse_indices", "sparse_values")


def token_counts(entities: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Each key with its own token count (null where there is no such row)."""
    return keys.select(*on).distinct().join(entities.select(*on, "bm25_token_count"), on, "left")


def snapshot_ids(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """repository_id, file_path, entity_id of the files asked for."""
    return by_keys(snapshots, files, ["repository_id", "file_path"]).select("repository_id", "file_path", F.explode("entity_ids").alias("entity_id"))


def delete_files(entities: DataFrame, snapshots: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Entities after the given files are deleted: every id of their snapshots is deleted softly."""
    return ingest.soft_delete(entities, snapshot_ids(snapshots, files), ["repository_id", "entity_id"], now)


def repository_list(repositories: DataFrame) -> DataFrame:
    """Newest first."""
    return repositories.select("repository_id", "repository_name", "repository_path", "created_at").orderBy(F.desc("created_at"), "repository_id")


def ensure_repository(repositories: DataFrame, new: DataFrame) -> DataFrame:
    """repositories with the new ones (by collection name), their average length at its start value."""
    return ingest.insert_absent(repositories, new.withColumn("bm25_avgdl", F.lit(DEFAULT_AVGDL)), ["collection_name"])


def set_flags(repositories: DataFrame, ids: list[str], **values) -> DataFrame:
    """Columns set for the given repositories (graph_ready, pending_relationship_resolution, last_indexed_commit, ...)."""
    hit = F.col("repository_id").isin(ids)
    return repositories.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def catch_up(old: DataFrame | None, new: DataFrame, commit: str, repositories: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """(changes since the last commit, repositories with the mark moved to the new one)."""
    return ingest.manifest_diff(old, new), set_flags(repositories, [repository], last_indexed_commit=commit)


def sibling_index(entities: DataFrame) -> DataFrame:
    """entities with position: the place among siblings of a kind by where they start, from 0."""
    order = Window.partitionBy("repository_id", "parent_scope", "entity_type").orderBy("start_line", "entity_id")
    return entities.withColumn("position", F.row_number().over(order) - 1)


def relationship_payload(edges: DataFrame) -> DataFrame:
    """entity_id and its outgoing relations as JSON text, sorted."""
    lists = F.sort_array(F.collect_set(F.struct("rel_type", F.col("dst").alias("target"))))
    return edges.groupBy(F.col("src").alias("entity_id")).agg(F.to_json(lists).alias("relationships"))


def payload_field(outbox: DataFrame, path: str, kind: str = "string") -> DataFrame:
    """outbox with column `field`, taken out of the JSON payload (null where the payload is broken or lacks it)."""
    return outbox.withColumn("field", F.try_variant_get(F.try_parse_json("payload"), path, kind))


def node_id(nodes: DataFrame, name: str, kind: str) -> DataFrame:
    """The id of a node by simple name and kind; of several the smallest."""
    return nodes.filter((F.col("name") == name) & (F.col("kind") == kind)).agg(F.min("id").alias("id"))


def parse_qualified(name: Column) -> Column:
    """struct(kind, type_path, trait_path, item) of a qualified name: simple, inherent impl <T>, or trait impl <T as Tr>, each maybe with ::item."""
    get = lambda pattern, i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    trait, plain = r"^(?:.*::)?<(.+) as (.+)>(?:::([^<>]+))?$", r"^(?:.*::)?<([^<>]+)>(?:::([^<>]+))?$"
    is_trait, is_plain = F.rlike(name, F.lit(trait)), F.rlike(name, F.lit(plain))
    return F.struct(
        F.when(is_trait, "trait_impl").when(is_plain, "inherent_impl").otherwise("simple").alias("kind"),
        F.when(is_trait, get(trait, 1)).when(is_plain, get(plain, 1)).alias("type_path"),
        F.when(is_trait, get(trait, 2)).alias("trait_path"),
        F.when(is_trait, get(trait, 3)).when(is_plain, get(plain, 2)).otherwise(F.element_at(F.split(name, "::"), -1)).alias("item"),
    )


def is_child(name: Column, parent: Column, sep: str = "::") -> Column:
    return F.startswith(name, F.concat(parent, F.lit(sep)))


def inside_root(path: Column, root: str) -> Column:
    """Whether a path without `..` parts is the root or below it."""
    base = root.rstrip("/")
    return ((path == base) | F.startswith(path, F.lit(base + "/"))) & ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))


def resolve_pending(spark: SparkSession, entities: DataFrame, repositories: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, external nodes, repositories) after resolving the repositories that are marked pending.

    Their old edges are replaced, so edges of changed entities do not stay; then the marks are set."""
    from codelode.plans.engine import build_edges

    dirty = repositories.filter("pending_relationship_resolution").select("repository_id")
    found, outside = build_edges(ingest.live(entities).join(dirty, "repository_id", "left_semi"))
    rest = edges.join(dirty, "repository_id", "left_anti")
    done = repositories.withColumns({"graph_ready": F.col("graph_ready") | F.col("pending_relationship_resolution"), "pending_relationship_resolution": F.lit(False)})
    return rest.unionByName(found), outside, done
