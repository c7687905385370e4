"""Keyed upserts, caches, snapshots and the change log, as DataFrame operations that give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.retrieval import DEFAULT_AVGDL

MAX_RETRIES, ERROR_BYTES, BATCH = 3, 1000, 500


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last by `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("__n = 1").drop("__n")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in by key; a row that comes in is live again (deleted_at null)."""
    if "deleted_at" in table.columns:
        rows = rows.withColumn("deleted_at", F.lit(None).cast(table.schema["deleted_at"].dataType))
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def classify(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """incoming with operation: UPDATE where a live row has the key, else INSERT (absent or deleted)."""
    known = stored.select(*keys, F.col("deleted_at").isNull().alias("__live"))
    joined = incoming.join(known, keys, "left")
    return joined.withColumn("operation", F.when(F.coalesce("__live", F.lit(False)), "UPDATE").otherwise("INSERT")).drop("__live")


def outbox_rows(rows: DataFrame, operation: Column | str, payload: Column, now: Column, stores: tuple[str, ...] = ("vector", "graph")) -> DataFrame:
    """One log row per target store for every row with repository_id, entity_id."""
    op = F.lit(operation) if isinstance(operation, str) else operation
    each = F.explode(F.array(*map(F.lit, stores)))
    rows = rows.select("repository_id", "entity_id", op.alias("operation"), payload.alias("payload"), now.alias("created_at"), each.alias("target_store"))
    return rows.select("*", F.lit(None).cast("timestamp").alias("processed_at"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"))


def store_entities(table: DataFrame, outbox: DataFrame, rows: DataFrame, keys: list[str], payload: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(table, log) after rows came in: both follow from one classification of the rows, so neither is written without the other."""
    marked = classify(keep_last(rows, keys, *[k for k in ("updated_at",) if k in rows.columns] or keys), table, keys)
    log = outbox_rows(marked, F.col("operation"), payload, now)
    return upsert(table, marked.drop("operation"), keys), outbox.unionByName(log, allowMissingColumns=True)


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """table without the rows of the given keys (a store that keeps no deleted rows)."""
    return table.join(keys.select(*on), on, "left_anti")


def counters(batches: DataFrame) -> DataFrame:
    """One row: every number column summed over the batches, 0 where there are none."""
    numbers = [f.name for f in batches.schema.fields if f.dataType.typeName() in ("integer", "long", "short", "byte")]
    return batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in numbers])


def soft_delete(table: DataFrame, keys: DataFrame, on: list[str], now: Column) -> DataFrame:
    """deleted_at set where the key is given and the row is live."""
    gone = keys.select(*on, F.lit(True).alias("__gone")).dropDuplicates(on)
    rows = table.join(gone, on, "left")
    when = F.when(F.col("__gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))
    return rows.withColumn("deleted_at", when).select(*table.columns)


def live(table: DataFrame) -> DataFrame:
    return table.filter("deleted_at IS NULL")


def cache_probe(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses); keys should name repository, model and content hash."""
    return wanted.join(cache, keys), wanted.join(cache.select(*keys), keys, "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of new keys, each key once (no row of the table changes)."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))


def insert_returning(table: DataFrame, rows: DataFrame, keys: list[str], position: str, name: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table with the rows of new keys; position and id of every row that came in, in its order, whether its key was new or known)."""
    new = keep_first(rows, keys, position).join(table.select(*keys), keys, "left_anti").withColumn(name, F.xxhash64(*keys))
    whole = table.unionByName(new.select(*table.columns))
    return whole, rows.select(position, *keys).join(whole.select(*keys, name), keys, "left").select(position, name).orderBy(position)


def with_ids(table: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    return table.withColumn(name, F.xxhash64(*keys))


def update_by_key(table: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Columns of `values` take the place of table's where the key is given."""
    new = [c for c in values.columns if c not in on]
    rows = table.join(values.select(*on, F.lit(True).alias("__set"), *[F.col(c).alias(f"__{c}") for c in new]), on, "left")
    return rows.select(*[F.when(F.col("__set"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def stale_ids(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and entity_id of snapshot ids that the new snapshot of the same file lacks."""
    flat = lambda df: df.select(*keys, F.explode("entity_ids").alias("entity_id")).distinct()
    seen = old.join(new.select(*keys), keys, "left_semi")
    return flat(seen).join(flat(new), [*keys, "entity_id"], "left_anti")


def ids_by_file(entities: DataFrame) -> DataFrame:
    return entities.groupBy("repository_id", "file_path").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))


def manifest_diff(old: DataFrame | None, new: DataFrame, path: str = "path", mark: str = "blob") -> DataFrame:
    """path, change of every file that is added, modified or deleted between two manifests; no old one counts as empty."""
    old = new.limit(0) if old is None else old
    both = old.select(path, F.col(mark).alias("__old")).join(new.select(path, F.col(mark).alias("__new")), path, "full_outer")
    change = F.when(F.col("__old").isNull(), "Added").when(F.col("__new").isNull(), "Deleted").when(F.col("__old") != F.col("__new"), "Modified")
    return both.select(path, change.alias("change")).filter("change IS NOT NULL")


# ---- change log


def pending(outbox: DataFrame, store: str | None = None, limit: int | None = None) -> DataFrame:
    """Unprocessed rows, oldest first."""
    rows = outbox.filter("processed_at IS NULL")
    rows = rows if store is None else rows.filter(F.col("target_store") == store)
    rows = rows.orderBy("created_at", "outbox_id")
    return rows if limit is None else rows.limit(limit)


def pending_count(outbox: DataFrame, store: str | None = None) -> DataFrame:
    """n: the unprocessed rows."""
    return pending(outbox, store).agg(F.count(F.lit(1)).alias("n"))


def claimable() -> Column:
    return F.col("processed_at").isNull() & (F.col("retry_count") < MAX_RETRIES)


def claim(outbox: DataFrame, limit: int | None = BATCH) -> DataFrame:
    """The oldest rows below the retry limit over all stores (all of them without a limit), then by store, collection and time."""
    rows = outbox.filter(claimable())
    if limit is not None:
        rows = rows.orderBy("created_at", "outbox_id").limit(limit)
    return rows.orderBy("target_store", "collection_name", "created_at", "outbox_id")


def settle(outbox: DataFrame, outcome: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(log after a batch, dead letters).  outcome: outbox_id, error (null: applied).  A failure adds a retry; at the limit the row is a dead letter and done."""
    rows = outbox.join(outcome.select("outbox_id", F.lit(True).alias("__tried"), F.col("error").alias("__error")), "outbox_id", "left")
    tried, failed = F.coalesce("__tried", F.lit(False)), F.col("__error").isNotNull()
    retries = F.col("retry_count") + F.when(tried & failed, 1).otherwise(0)
    done = tried & (~failed | (retries >= MAX_RETRIES))
    error = F.when(tried & failed, F.decode(F.substring(F.encode("__error", "utf-8"), 1, ERROR_BYTES), "utf-8")).otherwise(F.col("last_error"))
    new = rows.select(*[c for c in outbox.columns if c not in ("processed_at", "retry_count", "last_error")], F.when(done, now).otherwise(F.col("processed_at")).alias("processed_at"), retries.cast("int").alias("retry_count"), error.alias("last_error"))
    return new.select(*outbox.columns), new.filter((F.col("retry_count") >= MAX_RETRIES) & F.col("last_error").isNotNull())


# ---- BM25 counters


def add_stats(stats: DataFrame, added: DataFrame, removed: DataFrame | None = None, group: str = "repository_id") -> DataFrame:
    """Counters after adding and removing rows (group, tokens): never below 0; without rows the last average stays, 50 if there was none."""
    sums = lambda df, sign: df.groupBy(group).agg((sign * F.sum("tokens")).alias("t"), (sign * F.count(F.lit(1))).alias("c"))
    change = sums(added, 1) if removed is None else sums(added, 1).union(sums(removed, -1)).groupBy(group).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rows = stats.join(change, group, "full_outer")
    total = F.greatest(F.coalesce("total_tokens", F.lit(0)) + F.coalesce("t", F.lit(0)), F.lit(0))
    count = F.greatest(F.coalesce("n_entities", F.lit(0)) + F.coalesce("c", F.lit(0)), F.lit(0))
    average = F.when(count > 0, total.cast("double") / count).otherwise(F.coalesce("avgdl", F.lit(DEFAULT_AVGDL)))
    return rows.select(group, total.alias("total_tokens"), count.alias("n_entities"), average.alias("avgdl"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """n, bytes (4 per dimension), oldest, newest by model."""
    return cache.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding").cast("long") * 4).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def purge(table: DataFrame, column: str, values: list) -> DataFrame:
    """table without the rows of the given repositories, models, ...; nothing given: an empty table."""
    return table.filter(~F.col(column).isin(values) | F.col(column).isNull()) if values else table.limit(0)
