"""Incremental indexing: one job that ties extraction, embedding, upserts, stale deletes, snapshots and the change log."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.embedding import Provider
from codelode.operators import ingest, scans
from codelode.operators.tables import kept
from codelode.plans.engine import index

KEY, FILE = ["repository_id", "entity_id"], ["repository_id", "file_path"]


@dataclass
class Store:
    """The tables of an index; every step gives a new one."""

    entities: DataFrame
    snapshots: DataFrame
    cache: DataFrame
    outbox: DataFrame
    repositories: DataFrame


def reindex(store: Store, files: DataFrame, deleted: DataFrame, provider: Provider, model: str, commit: str, now: Column) -> tuple[Store, DataFrame]:
    """(store, counters) after files (repository_id, path, content, package) changed and deleted (repository_id, file_path) went.

    Changed files are extracted and embedded (equal texts once, known ones from the cache), their entities put in by key; ids of
    their old snapshot that they no longer have, and all ids of deleted files, are deleted softly.  Each change is logged once for
    each store, and repositories that changed are marked for resolution.  A file that is both given and deleted is given."""
    rows, fresh = index(files, store.cache, provider, model)
    rows = kept(rows.select([c for c in store.entities.columns if c in rows.columns]))
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(store.entities.schema[c].dataType).alias(c) for c in store.entities.columns])
    touched = files.select("repository_id", F.col("path").alias("file_path")).distinct()
    gone_files = deleted.select(*FILE).distinct().join(touched, FILE, "left_anti")
    new = ingest.ids_by_file(rows)
    new = touched.join(new, FILE, "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))
    stale = ingest.stale_ids(store.snapshots, new, FILE).select(*KEY)
    lost = scans.snapshot_ids(store.snapshots, gone_files).select(*KEY)
    moved = rows.select(*KEY)
    gone = kept(ingest.live(store.entities).select(*KEY).join(stale.union(lost).distinct(), KEY, "left_semi").join(moved, KEY, "left_anti"))
    marked = kept(ingest.classify(rows.select(*KEY), store.entities, KEY))
    entities = ingest.soft_delete(ingest.upsert(store.entities, rows, KEY), gone, KEY, now)
    payload = F.to_json(F.struct("repository_id", "entity_id"))
    changes = ingest.outbox_rows(marked, F.col("operation"), payload, now).union(ingest.outbox_rows(gone, "DELETE", payload, now))
    changes = changes.withColumn("outbox_id", F.sha2(F.concat_ws(":", "repository_id", "entity_id", "operation", "target_store", F.lit(commit)), 256))
    kinds = {f.name: f.dataType for f in store.snapshots.schema.fields}
    more = {"git_commit_hash": F.lit(commit), "indexed_at": now}
    snapshot = new.select(*[more[c].cast(kinds[c]).alias(c) if c in more else F.col(c) for c in store.snapshots.columns])
    snapshots = store.snapshots.join(gone_files, FILE, "left_anti")
    dirty = [r[0] for r in marked.select("repository_id").union(gone.select("repository_id")).distinct().collect()]
    counts = [
        files.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("what"), "n"),
        *[marked.filter(F.col("operation") == op).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for op, name in (("INSERT", "inserted"), ("UPDATE", "updated"))],
        gone.agg(F.count(F.lit(1)).alias("n")).select(F.lit("deleted").alias("what"), "n"),
    ]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.union(c)
    done = replace(
        store,
        entities=entities,
        snapshots=ingest.upsert(snapshots, snapshot, FILE),
        cache=store.cache.unionByName(fresh, allowMissingColumns=True),
        outbox=store.outbox.unionByName(changes, allowMissingColumns=True),
        repositories=scans.set_flags(store.repositories, dirty, pending_relationship_resolution=True, last_indexed_commit=commit) if dirty else store.repositories,
    )
    return done, whole


class Updater:
    """When to index again: 'main' follows commits of the main branch, 'live' every change, 'off' none."""

    def __init__(self, mode: str = "main", last_commit: str | None = None):
        if mode not in ("main", "live", "off"):
            raise ValueError(f"unknown update mode {mode!r}")
        self.mode, self.last_commit = mode, last_commit

    def due(self, branch: str, commit: str) -> bool:
        """For a poll in mode 'main': whether the commit is new and its branch is the main one."""
        from codelode.functions.text import MAIN_BRANCHES

        return self.mode == "main" and branch.lower() in MAIN_BRANCHES and commit != self.last_commit

    def poll(self, branch: str, commit: str, old: DataFrame | None, new: DataFrame, apply) -> bool:
        """Catch up from one manifest to another if due: `apply(changes)` gets path and change; the commit counts as done only after it."""
        if not self.due(branch, commit):
            return False
        apply(ingest.manifest_diff(old, new))
        self.last_commit = commit
        return True

    def start(self, changes: DataFrame, apply, checkpoint: str, drain: bool = False):
        """For mode 'live': a stream query that hands debounced, routed changes to `apply(batch)`; drain stops it when all that is there is done."""
        if self.mode != "live":
            return None
        from codelode.streaming.changes import route

        def step(batch: DataFrame, _: int) -> None:
            apply(route(batch))

        writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer).start()
