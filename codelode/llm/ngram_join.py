"""Exact n-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters.

1. Every text becomes its set of word shingles, as 64-bit fingerprints; equal
   sets are one node (so copies never multiply work).
2. All fingerprints meet by value, packed; a fingerprint that two sets share goes
   back to both with its document frequency.  Those that only one set has need no
   reply: they are that set's rarest.
3. A set's order is rare first.  Two sets at the limit must share a fingerprint
   among the first n - ceil(0.75 n) + 1 of each; sets whose prefix is all their
   own are done.
4. Sets that share a prefix fingerprint and pass the length and positional
   filters are candidates (a set's unshared fingerprints lie before all others
   and match nothing, which tightens the positional bound).  A large group first
   tries a star around its most central set and neighbours by size; members that
   are then connected need no more tests.  The last round tests every pair of sets
   that are still in different components, so no link between components is missed
   and no group is expanded into all its pairs while it is connected.
   A group of more than GROUP sets is dealt in blocks, each with the most central
   set of all; in the last round, if it is not yet connected, in pairs of blocks.
   So no task holds it.
5. Candidates pass the suffix filter, a bound on how much the rest of both sets
   differs: first by parity bitmaps of BITS bits that travel with the prefixes,
   then by counts in ranges of the fingerprint order.  Each pair is then verified
   once by intersecting the whole sets.

Fingerprints that a large share of a task's sets hold ("hot") are found first
over all rows; they skip step 2's meeting by value, as being the most frequent
they come last in any order.  Which ones count as hot has no effect on results.

Defined results: null text and text without words have an empty set and are
linked with nothing; fewer words than a shingle make one shingle; repeated rows
are one node; rows that share a doc_id are documents of their own; an empty table
gives an empty table; other columns are ignored.  Fingerprints have 64 bits.  The
number of buckets follows the measured bytes, so what a worker holds does not grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, bucket_count, even_keys, lean, materialise, mix, pack, read, text_blocks, texts, total_bytes, tune, unpack
from .components import components

WORDS = 5
BLOCK = 2 << 20
#: Fingerprints treated as hot: at most so many, each on so many sets at least.
HOT_KEYS, HOT_SETS = 65_536, 1000
#: Bits of the bitmaps and ranges of the suffix filter; groups up to SMALL try all their pairs at once; rounds before the last.
BITS, RANGES, SMALL, ROUNDS = 512, 256, 6, 1
#: Sets of one prefix fingerprint in a block.
GROUP = 1000
#: Bytes of packed postings for a byte of text.
POSTING = 2.5
SEED = 3


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words = words
        self.rolling = Rolling(SEED, BLOCK)
        self.factor = [np.uint64(pow(0x9E3779B97F4A7C15, j, 2**64)) for j in range(words)]
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def words_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the words, and the text that each belongs to."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        a = self.lower[data]
        gap = self.space[a]
        cut = np.zeros(len(a) + 1, bool)
        cut[offsets] = True
        start = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | cut[:-1]))
        end = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | cut[1:])) + 1
        return self.rolling.spans(self.rolling.prefix(a), start, end), np.searchsorted(offsets, start, "right") - 1

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (fingerprint, text) in the order of fingerprints; size and fingerprint of each text's set."""
        k, n = self.words, len(offsets) - 1
        word, of = self.words_of(data, offsets)
        key, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(word) >= k:
            m = len(word) - k + 1
            key = word[:m] * self.factor[0]
            for j in range(1, k):
                key += word[j : m + j] * self.factor[j]
            whole = of[:m] == of[k - 1 :]
            key, owner = mix(key[whole]), of[:m][whole]
        count = np.bincount(of, minlength=n)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            short = np.isin(of, few)
            at = np.flatnonzero(short)
            place = at - np.searchsorted(of, of[at])
            own = np.zeros(n, np.uint64)
            np.add.at(own, of[at], word[at] * np.array(self.factor, np.uint64)[place] + np.uint64(k + 1))
            key, owner = np.concatenate([key, mix(own[few])]), np.concatenate([owner, few])
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        tied = np.flatnonzero(key[1:] == key[:-1])
        if len(tied):  # owners rise within a key but for the short texts put last
            first = np.lexsort((owner, key))
            key, owner = key[first], owner[first]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, owner = key[fresh], owner[fresh]
        size = np.bincount(owner, minlength=n)
        by = np.argsort(owner, kind="stable")
        mark = np.zeros(n, np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(size)])[full]
            mark[full] = mix(np.add.reduceat(mix(key[by] ^ np.uint64(0x5851F42D4C957F2D)), starts) + size[full].astype(np.uint64))
        return key, owner, size, mark


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """kind 0: doc_id, n and sid of every document (sid null if n is 0), h a hash of its text; kind 1: sid is a fingerprint that n sets of a block hold."""

    @lean
    def run(batches):
        make, often = Shingler(words), {}
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("h", pa.int64())])
        for rows, data, offsets in text_blocks(batches, limit=BLOCK):
            key, owner, size, mark = make.sets(data, offsets)
            sid = pa.array(mark.view(np.int64), mask=size == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(size), np.int32)), rows.column(0).cast(pa.int64()), pa.array(size.astype(np.int64)), sid, rows.column(2)], schema=schema)
            runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            held = np.diff(np.append(runs, len(key)))
            for i in np.flatnonzero(held >= max(16, len(size) // 20)):
                k = int(key[runs[i]].view(np.int64))
                often[k] = often.get(k, 0) + int(held[i])
        keys, counts = list(often), list(often.values())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.nulls(len(keys), pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.int64())], schema=schema)

    tune(docs.sparkSession)
    return texts(docs, F.xxhash64(F.col("text").cast("string")).alias("h")).mapInArrow(run, "kind int, doc_id long, n long, sid long, h long")


def write_lists(sid: np.ndarray, n: np.ndarray, owner: np.ndarray, key: np.ndarray, more: np.ndarray | None = None) -> bytes:
    """Keys in rising order with their owners; only owners that occur are listed.  more: a 16-bit value for each key."""
    used, local = np.unique(owner, return_inverse=True)
    head = np.array([len(used), len(key)], np.int64).tobytes()
    planes = local.astype("<u4").view(np.uint8).reshape(-1, 4).T
    body = head + sid[used].astype(np.uint64).tobytes() + n[used].astype(np.uint32).tobytes() + pack(key) + np.ascontiguousarray(planes).tobytes()
    return body + (np.ascontiguousarray(more.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes() if more is not None else b"")


def read_lists(body: bytes) -> tuple[np.ndarray, ...]:
    """sid, n, owner, key, more."""
    sets, keys = np.frombuffer(body, np.int64, 2)
    at = 16
    sid = np.frombuffer(body, np.uint64, sets, at)
    n = np.frombuffer(body, np.uint32, sets, at := at + 8 * sets)
    key = unpack(body[(at := at + 4 * sets) : at + 8 * keys])
    raw = np.frombuffer(body, np.uint8, 4 * keys, at := at + 8 * keys).reshape(4, -1).T
    owner = np.ascontiguousarray(raw).view("<u4").ravel()
    rest = np.frombuffer(body, np.uint8, -1, at + 4 * keys)
    more = np.ascontiguousarray(rest.reshape(2, -1).T).view("<u2").ravel() if len(rest) else np.zeros(0, np.uint16)
    return sid, n, owner, key, more


def gather(table: pa.Table) -> tuple[np.ndarray, ...]:
    """All lists of a bucket: sid and n by set, owner, key and more by key."""
    parts = [read_lists(x.as_py()) for x in table.column("body")]
    base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    join = lambda i, kind: np.concatenate([p[i] for p in parts]).astype(kind, copy=False)
    owner = np.concatenate([p[2].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
    return join(0, np.uint64), join(1, np.int64), owner, join(3, np.uint64), join(4, np.uint16)


def split(bucket: np.ndarray, names: np.ndarray):
    """(name, places) of every bucket that occurs, places in rising order."""
    order = np.argsort(bucket.astype(np.uint16 if len(names) < 65_536 else np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=len(names)))
    for b in np.flatnonzero(np.diff(np.concatenate([[0], ends]))):
        yield int(names[b]), order[ends[b - 1] if b else 0 : ends[b]]


LISTS = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])


def rows_of(lists: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in lists], pa.int32()), pa.array([x for _, x in lists], pa.binary())], schema=LISTS)


def range_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit values a key is in."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def postings(docs: DataFrame, hot: np.ndarray, names: np.ndarray, words: int = WORDS) -> DataFrame:
    """Packed (fingerprint, set) lists by range of the fingerprint; hot ones by range of the set."""

    @lean
    def run(batches):
        make = Shingler(words)
        for _, data, offsets in text_blocks(batches, limit=BLOCK):
            key, owner, size, sid = make.sets(data, offsets)
            _, first = np.unique(sid, return_index=True)
            once = np.zeros(len(sid), bool)
            once[first] = True
            keep = once[owner]
            key, owner = key[keep], owner[keep]
            common = np.isin(key, hot)
            to = np.where(common, range_of(sid[owner], len(names)), range_of(key, len(names)))
            if len(key):
                yield rows_of([(b, write_lists(sid, size, owner[at], key[at])) for b, at in split(to, names)])

    return texts(docs).mapInArrow(run, "bucket int, body binary")


def shared(lists: DataFrame, hot: np.ndarray, names: np.ndarray) -> DataFrame:
    """Packed lists by range of the set: each set's fingerprints that another set has too, with their frequency (65535: that or more)."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        sid, n, owner, key, _ = gather(table)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        common = np.isin(key, hot)
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        keep = twice | common
        key, owner, common = key[keep], owner[keep], common[keep]
        order = np.lexsort((sid[owner], key))
        key, owner, common = key[order], owner[order], common[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sid[owner][1:] != sid[owner][:-1])
        key, owner, common = key[fresh], owner[fresh], common[fresh]
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(key) else np.zeros(0, np.int64)
        frequency = np.minimum(np.bincount(group)[group], 65_534) if len(key) else group
        frequency = np.where(common, 65_535, frequency)
        keep = frequency > 1
        key, owner, frequency = key[keep], owner[keep], frequency[keep]
        out = [(b, write_lists(sid, n, owner[at], key[at], frequency[at])) for b, at in split(range_of(sid[owner], len(names)), names)]
        return pa.Table.from_batches([rows_of(out)], LISTS)

    return lists.groupBy("bucket").applyInArrow(run, "bucket int, body binary")


def survivors(lists: DataFrame) -> DataFrame:
    """Sets with a shared fingerprint in their prefix: sid, n, own (unshared), keys (sorted), bits (parity bitmap of keys), prefix (rare first) as packed values."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        sid, n, owner, key, frequency = gather(table)
        mine = sid[owner]
        order = np.lexsort((key, frequency, mine))
        mine, key, owner = mine[order], key[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(mine))
        out = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            size = int(n[owner[a]])
            own = size - (b - a)
            first = size // 4 + 1 - own
            if first > 0:
                keys = np.sort(key[a:b])
                parity = np.bincount(range_of(mix(keys), BITS), minlength=BITS) & 1
                out.append((int(mine[a].view(np.int64)), size, own, keys.tobytes(), np.packbits(parity.astype(bool)).tobytes(), key[a : a + first].tobytes()))
        kinds = [("sid", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("keys", pa.binary()), ("bits", pa.binary()), ("prefix", pa.binary())]
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds)})

    return lists.groupBy("bucket").applyInArrow(run, "sid long, n long, own long, keys binary, bits binary, prefix binary")


def prefixes(alive: DataFrame) -> DataFrame:
    """One row per prefix fingerprint: key, sid, n, own, at (its place in the order), bits."""

    @lean
    def run(batches):
        for batch in batches:
            keys = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(4)]
            if not keys:
                continue
            size = np.array([len(k) for k in keys])
            of = np.repeat(np.arange(len(keys)), size)
            own = np.asarray(batch.column(2))
            at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + own[of]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[batch.column(i).take(pa.array(of)) for i in (0, 1, 2)], pa.array(at), batch.column(3).take(pa.array(of))], names=["key", "sid", "n", "own", "at", "bits"])

    return alive.select("sid", "n", "own", "bits", "prefix").mapInArrow(run, "key long, sid long, n long, own long, at long, bits binary")


def passes(n1, n2, a1, a2, own1, own2) -> np.ndarray:
    """Length and positional filters for sets of n1 and n2 that share the element at places a1 and a2."""
    near = 4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)
    most = np.minimum(a1 - own1, a2 - own2) + 1 + np.minimum(n1 - a1 - 1, n2 - a2 - 1)
    return near & (7 * most >= 3 * (n1 + n2))


def candidates(rows: DataFrame, last: bool, names: np.ndarray) -> DataFrame:
    """Distinct pairs x < y of sets in different components (column comp) that share a prefix fingerprint and pass the filters."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        key, sid, n, own, at, comp = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "sid", "n", "own", "at", "comp"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        order = np.lexsort((sid, n, key))
        key, sid, n, own, at, comp, bits = (x[order] for x in (key, sid, n, own, at, comp, bits))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(key)))
        if len(key):  # a group that is one component has nothing to test
            split_up = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
            keep = np.repeat(split_up, size)
            sid, n, own, at, comp, bits = (x[keep] for x in (sid, n, own, at, comp, bits))
            size = size[split_up]
            starts = np.cumsum(size) - size
        until = np.repeat(starts + size, size)
        everything = np.repeat(last | (size <= SMALL), size)
        found, held = [np.zeros((0, 2), np.int64)], 0

        def pairs(i, j):
            ok = (comp[i] != comp[j]) & passes(n[i], n[j], at[i], at[j], own[i], own[j])
            i, j = i[ok], j[ok]
            # unshared elements all differ; of the shared ones at least the bits that differ
            apart = own[i] + own[j] + np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            ok = 7 * apart <= n[i] + n[j]
            i, j = sid[i[ok]], sid[j[ok]]
            return np.column_stack([np.minimum(i, j), np.maximum(i, j)])

        step, live = 1, np.arange(len(sid))
        while len(live):
            live = live[live + step < until[live]]
            if step > 1:
                live = live[everything[live]]
            found.append(pairs(live, live + step))
            held += len(found[-1])
            if held > 1_000_000:
                found, held = [np.unique(np.concatenate(found), axis=0)], 0
            live, step = live[4 * n[live] >= 3 * n[live + step]], step + 1  # sizes rise: further ones differ more
        if not last and len(sid):
            group = np.repeat(np.arange(len(size)), size)
            central = np.lexsort((sid, own / n, group))[starts]
            found.append(pairs(np.repeat(central, size), np.arange(len(sid))))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.table({"x": pa.array(out[:, 0]), "y": pa.array(out[:, 1])})

    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.col("own") / F.col("n")).alias("least")).filter(F.col("m") > GROUP)
    blocks = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.ceil(F.col("m") / GROUP)).cast("int")
    large = materialise(size.select("key", blocks.alias("blocks"), "least"))
    if not large.isEmpty():
        central = rows.join(large, "key").filter(F.col("own") / F.col("n") == F.col("least")).groupBy("key").agg(F.min("sid").alias("center"))
        rows = rows.join(materialise(large.join(central, "key").select("key", "blocks", "center")), "key", "left").filter("blocks IS NULL OR blocks > 0")
        own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        if last:  # every row goes to each pair of blocks that its own block is in
            tasks = F.transform(every, lambda b: F.xxhash64("key", F.least(b, own), F.greatest(b, own)))
        else:  # every row goes to its own block, the most central one to all
            tasks = F.transform(F.when(F.col("sid") == F.col("center"), every).otherwise(F.array(own)), lambda b: F.xxhash64("key", b))
        rows = rows.withColumn("key", F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(tasks))).drop("blocks", "center")
    few = names[:4096]  # a literal of the plan; so many spread evenly by chance, too
    name = F.element_at(F.array(*[F.lit(int(k)) for k in few]), F.pmod(F.xxhash64("key"), F.lit(len(few))).cast("int") + 1)
    if len(names) > len(few):
        name = F.pmod(F.xxhash64("key"), F.lit(len(names))).cast("int")
    return rows.withColumn("bucket", name).groupBy("bucket").applyInArrow(run, "x long, y long").distinct()


@lean
def _verify(batches):
    """Suffix filter and exact intersection of the sorted sets."""
    edges = (np.arange(1, RANGES, dtype=np.uint64) << np.uint64(32)) // np.uint64(RANGES) << np.uint64(32)
    for batch in batches:
        ok = np.zeros(len(batch), bool)
        need = 3 * (np.asarray(batch.column(2)) + np.asarray(batch.column(3)))
        for i in range(len(batch)):
            a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (4, 5))
            if 7 * min(len(a), len(b)) < need[i]:
                continue
            cuts = [np.diff(np.concatenate([[0], np.searchsorted(k, edges), [len(k)]])) for k in (a, b)]
            if 7 * int(np.minimum(*cuts).sum()) >= need[i]:
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                ok[i] = 7 * int((b[at] == a).sum()) >= need[i]
        yield batch.select([0, 1]).filter(pa.array(ok))


def links(pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """The pairs x, y at the limit or above."""
    side = lambda c: alive.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "n_x", "n_y", "keys_x", "keys_y")
    return both.mapInArrow(_verify, "x long, y long")


def join_sets(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with n, sid and h, verified links x y that join all components, labels node root of linked sets)."""
    spark = docs.sparkSession
    names = even_keys(spark, bucket_count(spark, POSTING * total_bytes(docs)))
    sets = materialise(shingle_sets(docs, words))
    hot_rows = sets.filter("kind = 1").groupBy("sid").agg(F.sum("n").alias("c")).filter(F.col("c") >= HOT_SETS).orderBy(F.desc("c"), "sid").limit(HOT_KEYS).collect()
    hot = np.sort(np.array([r.sid for r in hot_rows], np.int64).view(np.uint64))
    alive = materialise(survivors(shared(postings(docs, hot, names, words), hot, names)))
    prefix = prefixes(alive)
    labels, all_links = None, None
    for round_ in range(ROUNDS + 1):
        rows = prefix.withColumn("comp", F.col("sid"))
        if labels is not None:
            rows = prefix.join(labels, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "sid")).drop("node", "root")
        found = materialise(links(candidates(rows, round_ == ROUNDS, names), alive))
        if found.isEmpty():
            continue
        all_links = found if all_links is None else all_links.union(found)
        labels = components(all_links, "x", "y")
    empty = spark.createDataFrame([], "x long, y long")
    labels = labels if labels is not None else empty.toDF("node", "root")
    return sets.filter("kind = 0").select("doc_id", "n", "sid", "h"), all_links if all_links is not None else empty, labels


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), root (of its component, null for an empty set), h (hash of the text)."""
    found, _, labels = join_sets(docs, words)
    first = found.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first"))
    of = first.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(least, "root").select(F.col("sid").alias("of"), "component_id", "root")
    return found.join(of, F.col("sid") == F.col("of"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", "h")


#: Ids of dropped documents that may be sent to every executor (16 bytes each); beyond, they are joined by id.
BROADCAST_IDS = 500_000


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with all their columns, of each component only the one of smallest doc_id; equal rows once.

    Of several texts with that doc_id the one of least hash stays; rows without a doc_id stay."""
    found = materialise(near_duplicates(docs, words))
    gone = found.filter("component_id != doc_id").select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h"))
    twice = found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__twice"))
    n = twice.count()
    if n:  # some ids stand for several rows: each is a document of its own
        same = found.filter("component_id = doc_id AND root IS NOT NULL").join(twice, F.col("doc_id") == F.col("__twice"))
        least = same.groupBy(F.col("root").alias("of"), F.col("doc_id").alias("id")).agg(F.min("h").alias("least"))
        worse = same.join(least, (F.col("root") == F.col("of")) & (F.col("doc_id") == F.col("id"))).filter("h != least")
        gone = gone.union(worse.select("doc_id", "h"))
    gone = gone.distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same_row = docs["doc_id"] == F.col("__doc")
    if n:
        same_row = same_row & (F.xxhash64(docs["text"].cast("string")) == F.col("__h"))
    kept = docs.join(gone, same_row, "left_anti")
    if not n:
        return kept
    twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    of = kept["doc_id"] == F.col("__twice")
    return kept.join(twice, of, "left_anti").union(kept.join(twice, of, "left_semi").dropDuplicates())


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x WHERE r.root < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
