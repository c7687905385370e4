"""File-change streams: debouncing, routing, filters; batch and streaming forms of the same rules."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators.ingest import MAX_RETRIES, claim, claimable, settle
from codelode.operators.tables import kept, new_folder, sliced

WINDOW_MS = 500
MAX_BYTES = 10 * 1024 * 1024
# Kinds of file changes in the order in which a batch applies them.
PRIORITY = ["Deleted", "Modified", "Renamed", "Created", "PermissionsChanged"]


def merge_kind(held: str, new: str) -> str:
    """The latest kind wins, but a file created within the window stays created when it is modified."""
    return held if (held, new) == ("Created", "Modified") else new


class Debouncer:
    """Windows of one path: the first event opens one of fixed length, which later events do not extend."""

    def __init__(self, window_us: int):
        self.window, self.path, self.held = window_us, None, None

    def push(self, path, ts, kind):
        """The closed window as (path, first, last, kind, n), or None."""
        if self.held and self.path == path and ts < self.held[0] + self.window:
            first, _, old, n = self.held
            self.held = (first, ts, merge_kind(old, kind), n + 1)
            return None
        done = self.close()
        self.path, self.held = path, (ts, ts, kind, 1)
        return done

    def close(self):
        done = (self.path, *self.held) if self.held else None
        self.held = None
        return done


def debounce(changes: DataFrame, window_ms: int = WINDOW_MS, path: str = "path", ts: str = "ts", kind: str = "change_type", *tie: str) -> DataFrame:
    """path, window_start, last_ts, change_type, n_events of every window.

    Rows stream through in order, one window held at a time: a path of any number of events needs no memory."""
    kind_of = changes.schema[path].dataType.simpleString()
    names = ["path", "window_start", "last_ts", "change_type", "n_events"]

    def run(batches):
        held = Debouncer(window_ms * 1000)
        schema = None
        for batch in batches:
            schema = pa.schema([("path", batch.schema.field(0).type), ("window_start", pa.int64()), ("last_ts", pa.int64()), ("change_type", pa.string()), ("n_events", pa.int64())])
            done = [held.push(*row) for row in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done if d], schema)
        if last := held.close():
            yield pa.RecordBatch.from_pylist([dict(zip(names, last, strict=True))], schema)

    rows = changes.select(path, F.unix_micros(F.col(ts).cast("timestamp")).alias("__ts"), kind, *tie).repartition(path).sortWithinPartitions(path, "__ts", *tie)
    out = rows.mapInArrow(run, f"path {kind_of}, window_start long, last_ts long, change_type string, n_events long")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("window_start", "last_ts")})


def debounce_stream(changes: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """The same over a stream with a watermark on ts: a window is given out when its time has passed."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = "path string, window_start timestamp, last_ts timestamp, change_type string, n_events long"
    state = "first long, last long, kind string, n long"

    def run(key, parts, held: GroupState):
        done = []

        def give(s):
            done.append({"path": key[0], "window_start": pd.Timestamp(s[0], unit="us"), "last_ts": pd.Timestamp(s[1], unit="us"), "change_type": s[2], "n_events": s[3]})

        if held.hasTimedOut:
            give(held.get)
            held.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
            now = held.get if held.exists else None
            for ts, kind in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["change_type"], strict=True):
                if now and ts < now[0] + window_ms * 1000:
                    now = (now[0], ts, merge_kind(now[2], kind), now[3] + 1)
                else:
                    if now:
                        give(now)
                    now = (ts, ts, kind, 1)
            held.update(tuple(int(x) if i != 2 else x for i, x in enumerate(now)))
            held.setTimeoutTimestamp(max(int(now[0]) // 1000 + window_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["path", "window_start", "last_ts", "change_type", "n_events"])

    rows = changes.select("path", "ts", "change_type")
    return rows.groupBy("path").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def route(changes: DataFrame) -> DataFrame:
    """action, path of every change: index, delete, or both for a rename; permission changes are dropped."""
    act = lambda name, col: F.struct(F.lit(name).alias("action"), F.col(col).alias("path"))
    actions = (
        F.when(F.col("change_type").isin("Created", "Modified"), F.array(act("index", "path")))
        .when(F.col("change_type") == "Deleted", F.array(act("delete", "path")))
        .when(F.col("change_type") == "Renamed", F.array(act("delete", "path"), act("index", "new_path")))
    )
    return changes.select(F.explode(actions).alias("a")).select("a.*")


def priority(kind: Column) -> Column:
    """Place of a kind of change in a batch; unknown kinds come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), kind), F.lit(0)), F.lit(99))


def by_priority(changes: DataFrame, *tie: str) -> DataFrame:
    return changes.orderBy(priority(F.col("change_type")), *tie)


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: `**` any path, `*` and `?` within a part."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".^$+{}[]()|\\" else c), i + 1
    return f"^(?:{out})$"


def wanted(path: Column, size: Column, ignore: list[str] = (), extensions: list[str] | None = None) -> Column:
    """Files within the size limit, of the extensions, that the ignore globs (of the whole path or its last part) leave.

    The last glob that matches decides: one that begins with `!` takes a file back in."""
    ignored = F.lit(False)
    for g in ignore:
        glob = F.lit(glob_pattern(g.removeprefix("!")))
        hit = F.rlike(path, glob) | F.rlike(F.element_at(F.split(path, "/"), -1), glob)
        ignored = F.when(hit, F.lit(not g.startswith("!"))).otherwise(ignored)
    ok = (size <= MAX_BYTES) & ~ignored
    if extensions:
        ok = ok & F.lower(F.element_at(F.split(path, r"\."), -1)).isin(extensions) & F.contains(path, F.lit("."))
    return ok


def tumbling(events: DataFrame, width: str, ts: str = "ts", *keys: str) -> DataFrame:
    rows = events.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts") -> DataFrame:
    rows = events.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("session_window.start").alias("session_start"), "n")


def apply_outbox(batch: DataFrame, sink, error_of, now: Column, outbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of the log applier for foreachBatch, on every claimable row of the micro-batch.

    `sink(rows)` writes by key (so a repeat is harmless); `error_of(rows)` gives outbox_id, error.  If the sink raises,
    nothing is settled and the batch is tried again as a whole."""
    rows = claim(batch, None)
    sink(rows)
    return settle(outbox, error_of(rows), now)


def drain(outbox: DataFrame, sink, error_of, now: Column, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """(log, dead letters) after claiming, applying and settling batches until no row is left to try; every row is tried at most as often as it may be.

    A batch is the oldest rows that are left, those tried in vain included.  The open rows lie in slices of a batch each and a
    step takes up the next slice when fewer are in hand, so a step costs by its batch and not by the log."""
    spark, waiting = outbox.sparkSession, F.coalesce(claimable(), F.lit(False))
    slices, path, tried = sliced(outbox.filter(waiting), batch, "created_at", "outbox_id"), new_folder(outbox.sparkSession), False
    hand, n = None, 0
    for i, more in enumerate(slices, 1):
        hand = more if n == 0 else hand.unionByName(more)
        n = hand.count()
        while n >= batch or (n and i == len(slices)):
            rows = kept(claim(hand, batch))
            sink(rows)
            after = kept(settle(hand, error_of(rows), now)[0])
            after.filter(~waiting).write.mode("append").parquet(path)
            hand, tried = after.filter(waiting), True
            n = hand.count()
    if not tried:
        return outbox, outbox.limit(0)
    whole = outbox.filter(~waiting).unionByName(spark.read.schema(outbox.schema).parquet(path))
    return whole, whole.filter((F.col("retry_count") >= MAX_RETRIES) & F.col("last_error").isNotNull())
