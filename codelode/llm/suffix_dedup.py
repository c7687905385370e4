"""Exact substring deduplication by two-stage suffix sorting.

A byte goes if a string of WIDTH bytes that covers it also starts earlier, in a
smaller doc_id or earlier in the same document.  The suffix arrays are built in
many small pieces such that equal strings always meet in one piece:

1. Every WIDTH-byte window is owned by its anchor, the GRAM-byte string of least
   fingerprint in it (the leftmost of equal ones).  Windows in a row with one
   anchor form a segment, at most 2 * WIDTH - GRAM bytes.  Equal windows have
   equal anchors, so they lie in segments of one anchor.
2. Anchors meet as fingerprints only, one for each HELD bytes of text that have
   them.  An anchor that occurs once holds no repeated window and is done; the
   documents of all others learn which of their segments to send.
   An anchor in front of many different segments (a common line in many contexts)
   would fill one piece: its segments are split by all bytes of their windows,
   each window being a segment of its own, and these meet in the same way.
3. The bytes of the segments left meet by anchor (or window).  Equal segments,
   compared byte by byte, enter a piece once, as their first place; the others
   are later copies of it.
   Each piece is one text, and its suffixes are sorted in two stages: those
   smaller than their successor are sorted directly, all others are induced from
   them by a scan over the buckets of first symbols.  Adjacent common prefixes
   give the groups of equal windows; all but the first place of each go.
4. The removed ranges of a document meet its text, and the rest is kept.

Fingerprints only choose what meets; every removal is decided on bytes.  Defined
results: null text is empty; texts shorter than WIDTH keep all; rows of one
doc_id are one document seen twice (no row removes the other's bytes); a null
doc_id is a document before all others; an empty table gives an empty table;
other columns are ignored; long texts are cut into overlapping parts of PART
bytes, which changes no window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, bucket_count, even_keys, materialise, mix, pack, read, text_blocks, total_bytes, tune, unpack
from .ngram_join import range_of, split

WIDTH, GRAM = 100, 32
#: Different segments of one anchor beyond which they are split by their windows, and the most anchors that are.
HOT, HOT_KEYS = 20_000, 1 << 22
#: Bytes of one suffix array; an anchor's segments stay in one.
PIECE = 1 << 20
#: Bytes of text whose keys, and bytes of segments, that a worker holds before it sends them.
HELD, HELD_BYTES = 32 << 20, 8 << 20
#: Bytes of a text looked at together; low bits of a packed minimum hold the place in it.
PART, PLACE = 4 << 20, 24
NO_ID = -(2**63)
EVEN = np.uint64(2**64 - 2)


class Fingerprints:
    """The two families of fingerprints: of anchors and windows, and of contents."""

    def __init__(self):
        self.first, self.second = Rolling(31), Rolling(32)


def _parts(offsets: np.ndarray):
    """Runs of whole texts as (from, to, first text); a text beyond PART bytes in overlapping runs of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1, a + 1)
        if b > a + 1 or offsets[b] - offsets[a] <= PART:
            yield int(offsets[a]), int(offsets[b]), a, b
        else:
            for at in range(int(offsets[a]), int(offsets[b]) - WIDTH + 1, PART - WIDTH + 1):
                yield at, min(at + PART, int(offsets[b])), a, b
        a = b


def segments(data: np.ndarray, offsets: np.ndarray, marks: Fingerprints) -> tuple[np.ndarray, ...]:
    """anchor, content fingerprint, text number, first window (from the text's start) and number of windows of every segment of a block."""
    none = np.zeros(0, np.int64)
    out = [(none.astype(np.uint64), none.astype(np.uint64), none, none, none)]
    for lo, hi, a, b in _parts(offsets):
        inner = np.clip(offsets[a : b + 1], lo, hi) - lo
        key, content, of, start, length = _segments(data[lo:hi], inner, marks)
        of = of + a
        out.append((key, content, of, start + lo - offsets[of], length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segments(data: np.ndarray, offsets: np.ndarray, marks: Fingerprints) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    grams = marks.first.windows(marks.first.prefix(data), GRAM)
    n = len(data) - WIDTH + 1
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    least = (grams >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, WIDTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    anchor = (np.minimum(least[:n], least[width - span : width - span + n]) & np.uint64(2**PLACE - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= WIDTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[1:] - WIDTH + 1)[long], -1)
    valid = np.cumsum(inside[:n]) > 0
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    begin = np.zeros(n + 1, bool)
    begin[offsets[:-1][offsets[:-1] <= n]] = True  # the last window of a text and the first of the next are never neighbours
    starts = np.flatnonzero(edge | begin[:n])
    length = np.diff(np.append(starts, n))
    keep = valid[starts]
    starts, length = starts[keep], length[keep]
    content = marks.second.spans(marks.second.prefix(data), starts, starts + length + WIDTH - 1)
    of = np.searchsorted(offsets, starts, "right") - 1
    return grams[anchor[starts]] & EVEN, content, of, starts, length


def windows_of(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, at: np.ndarray, length: np.ndarray, marks: Fingerprints) -> tuple[np.ndarray, ...]:
    """The windows of the given segments, as segments of one window each: key, text number, place."""
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    of, at = np.repeat(of, length), np.repeat(at, length) + step
    if not len(of):
        return np.zeros(0, np.uint64), of, at
    prefix = marks.second.prefix(data)
    place = at + offsets[of]
    return marks.second.spans(prefix, place, place + WIDTH) & EVEN, of, at


def by_planes(values: np.ndarray, kind: str) -> bytes:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document joined where they touch or overlap."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    rank = np.cumsum(new)
    top = np.maximum.accumulate(hi + rank * 2**40) - rank * 2**40
    cut = np.flatnonzero(new | np.concatenate([[True], lo[1:] > top[:-1]]))
    return doc[cut], lo[cut], top[np.append(cut[1:], len(doc)) - 1]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")


def spread(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; anchors are least fingerprints, so their own ranges would be uneven."""
    return range_of(mix(key.copy()), buckets)


# ---- step 2: keys that occur again


def write_keys(key: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> bytes:
    """Keys in rising order with their documents (as a list and places in it) and marks."""
    docs, local = np.unique(doc, return_inverse=True)
    return np.array([len(docs), len(key)], np.int64).tobytes() + docs.tobytes() + pack(key) + by_planes(local, "<u4") + by_planes(mark, "<u4")


def read_keys(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, n = (int(x) for x in np.frombuffer(body, np.int64, 2))
    ids, at = np.frombuffer(body, np.int64, docs, 16), 16 + 8 * docs
    planes = [from_planes(body[i : i + 4 * n], "<u4").astype(np.int64) for i in (at + 8 * n, at + 12 * n)]
    return unpack(body[at : at + 8 * n]), ids[planes[0]], planes[1]


def once_each(key: np.ndarray, content: np.ndarray, doc: np.ndarray, names: np.ndarray) -> list[tuple[int, bytes]]:
    """Lists by bucket: each key once, marked by twice the number of its contents, plus 1 if it occurs again here; mark 0: a key of a document, known to occur again."""
    order = np.lexsort((doc, content, key))
    key, content, doc = key[order], content[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    other = fresh.copy()
    other[1:] |= content[1:] != content[:-1]
    group = np.cumsum(fresh) - 1
    again = np.bincount(group) > 1
    mark = 2 * np.bincount(group, other).astype(np.int64) + again
    known = again[group]
    pairs = np.unique(np.column_stack([doc[known], key[known].view(np.int64)]), axis=0)
    known_doc, known_key = pairs[:, 0], np.ascontiguousarray(pairs[:, 1]).view(np.uint64)
    all_keys, all_docs = np.concatenate([key[fresh], known_key]), np.concatenate([doc[fresh], known_doc])
    marks = np.concatenate([mark, np.zeros(len(pairs), np.int64)])
    to = np.concatenate([spread(key[fresh], len(names)), spread(known_doc.view(np.uint64), len(names))])
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_docs, marks, to = all_keys[order], all_docs[order], marks[order], to[order]
    return [(b, write_keys(all_keys[i], all_docs[i], marks[i])) for b, i in split(to, names)]


def lists_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "body"])


def meeting(docs: DataFrame, names: np.ndarray, hot: np.ndarray | None = None) -> DataFrame:
    """Packed keys of the segments of every whole text; with hot, of the windows of segments whose anchor is one of these."""

    def run(batches):
        marks, held, size = Fingerprints(), [], 0
        for rows, data, offsets in text_blocks(batches):
            ids = np.asarray(rows.column(0))
            key, content, of, at, length = segments(data, offsets, marks)
            if hot is not None:
                wide = np.isin(key, hot)
                key, of, _ = windows_of(data, offsets, of[wide], at[wide], length[wide], marks)
                content = key
            held.append((key, content, ids[of]))
            size += max(len(data), 40 * len(key))
            if size > HELD:
                yield lists_of(once_each(*(np.concatenate(x) for x in zip(*held, strict=True)), names))
                held, size = [], 0
        if held:
            yield lists_of(once_each(*(np.concatenate(x) for x in zip(*held, strict=True)), names))

    tune(docs.sparkSession)
    return _keyed(docs).mapInArrow(run, "bucket int, body binary")


def recurring(lists: DataFrame, limit: int) -> DataFrame:
    """doc and keys (packed) of its segments whose key occurs again; doc null: a key with more than `limit` contents, and their number."""
    schema = pa.schema([("doc", pa.int64()), ("keys", pa.binary()), ("hot", pa.int64()), ("contents", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        parts = [read_keys(x.as_py()) for x in table.column("body")]
        key, doc, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
        told = mark == 0
        known_key, known_doc = key[told], doc[told]
        key, doc, mark = key[~told], doc[~told], mark[~told]
        order = np.argsort(key, kind="stable")
        key, doc, mark = key[order], doc[order], mark[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        group = np.cumsum(fresh) - 1
        contents = np.bincount(group, mark >> 1).astype(np.int64)
        tell = (np.bincount(group)[group] > 1) & (mark & 1 == 0) if len(key) else fresh
        key_, doc_ = np.concatenate([key[tell], known_key]), np.concatenate([doc[tell], known_doc])
        order = np.argsort(doc_, kind="stable")
        key_, doc_ = key_[order], doc_[order]
        starts = np.flatnonzero(np.concatenate([[True], doc_[1:] != doc_[:-1]])) if len(doc_) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(doc_))
        bodies = [key_[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        wide = np.flatnonzero(contents > limit)
        n, m = len(starts), len(wide)
        return pa.table(
            [
                pa.array([*doc_[starts].tolist(), *[None] * m], pa.int64()),
                pa.array([*bodies, *[None] * m], pa.binary()),
                pa.array([*[None] * n, *key[fresh][wide].view(np.int64).tolist()], pa.int64()),
                pa.array([*[None] * n, *contents[wide].tolist()], pa.int64()),
            ],
            schema=schema,
        )

    return lists.groupBy("bucket").applyInArrow(run, "doc long, keys binary, hot long, contents long")


# ---- step 3: their bytes


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def representatives(key: np.ndarray, content: np.ndarray, doc: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): the segments that stand for all that equal them byte by byte under their key, and the ones with another place."""
    order = np.lexsort((at, doc, length, content, key))
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (key, content, length)])
    rank = np.arange(len(order))
    first = order[np.maximum.accumulate(np.where(same, 0, rank))] if len(order) else order
    step = max(1, (4 << 20) // (2 * WIDTH))
    wrong = []
    again = np.flatnonzero(same)
    for i in range(0, len(again), step):
        a, b = order[again[i : i + step]], first[again[i : i + step]]
        differ = gather(data, start[a], length[a]) != gather(data, start[b], length[b])
        wrong += again[i : i + step][np.add.reduceat(differ, np.cumsum(length[a]) - length[a]) > 0].tolist()
    seen: dict[tuple[int, bytes], int] = {}
    for i in wrong:  # fingerprints agreed, bytes did not
        x = order[i]
        first[i] = seen.setdefault((int(key[x]), data[start[x] : start[x] + length[x]].tobytes()), int(x))
    own = first == order
    later = ~own & ((doc[order] != doc[first]) | (at[order] != at[first]))
    return order[own], order[later]


def write_bytes(key, doc, lo, length, data) -> bytes:
    """Segments in rising order of key, compressed; their numbers by planes."""
    raw = b"".join(by_planes(x.view(np.int64), "<i8") for x in (key, doc, lo, length)) + data.tobytes()
    return np.array([len(key), len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def read_bytes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows key, doc, lo and length; the bytes."""
    n, size = (int(x) for x in np.frombuffer(body, np.int64, 2))
    raw = pa.decompress(body[16:], size, "zstd", asbytes=True)
    return np.stack([from_planes(raw[8 * n * i : 8 * n * (i + 1)], "<i8") for i in range(4)]), np.frombuffer(raw, np.uint8, -1, 32 * n)


def write_ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Told from segments by a negative number."""
    return np.concatenate([[-len(doc)], doc, lo, hi]).astype(np.int64).tobytes()


def sending(docs: DataFrame, told: DataFrame, hot: np.ndarray, names: np.ndarray) -> DataFrame:
    """Packed bytes of the segments with recurring keys, equal ones once, by key; ranges of their later copies, by document."""
    own = told.groupBy("doc").agg(F.collect_list("keys").alias("keys"))
    rows = _keyed(docs).join(own.hint("shuffle_hash"), "doc").select("doc", "text", "keys")

    def flush(held) -> pa.RecordBatch:
        key, content, doc, at, length, data = (np.concatenate(x) for x in zip(*held, strict=True))
        start = np.cumsum(length) - length
        first, later = representatives(key, content, doc, at, data, start, length)
        lists = [(b, write_bytes(key[i], doc[i], at[i], length[i], gather(data, start[i], length[i]))) for b, i in ((b, first[i]) for b, i in split(spread(key[first], len(names)), names))]
        gone, lo, hi = merged(doc[later], at[later], at[later] + length[later])
        return lists_of(lists + [(b, write_ranges(gone[i], lo[i], hi[i])) for b, i in split(spread(gone.view(np.uint64), len(names)), names)])

    def run(batches):
        marks, held, size = Fingerprints(), [], 0
        for rows, data, offsets in text_blocks(batches):
            ids = np.asarray(rows.column(0))
            keys = [np.frombuffer(b"".join(x), np.uint64) for x in rows.column(2).to_pylist()]
            stride = np.uint64(0x9E3779B97F4A7C15)
            asked = np.sort(mix(np.concatenate(keys) + np.repeat(np.arange(len(keys), dtype=np.uint64), [len(k) for k in keys]) * stride))

            def wanted(key, of, asked=asked):
                mine = mix(key + of.astype(np.uint64) * stride)
                return asked[np.minimum(np.searchsorted(asked, mine), len(asked) - 1)] == mine if len(asked) else np.zeros(len(mine), bool)

            key, content, of, at, length = segments(data, offsets, marks)
            if len(hot):
                wide = np.isin(key, hot)
                key1, of1, at1 = windows_of(data, offsets, of[wide], at[wide], length[wide], marks)
                key, content, of, at, length = (np.concatenate([x[~wide], y]) for x, y in zip((key, content, of, at, length), (key1, key1, of1, at1, np.ones(len(of1), np.int64)), strict=True))
            ok = wanted(key, of)
            key, content, of, at, length = (x[ok] for x in (key, content, of, at, length))
            length = length + WIDTH - 1
            part = gather(data, at + offsets[of], length)
            held.append((key, content, ids[of], at, length, part))
            size += len(part) + 40 * len(key)
            if size > HELD_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "bucket int, body binary")


class SuffixArray:
    """Suffixes of a list of byte strings, sorted by WIDTH symbols at least; a separator (symbol 0) follows each string."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, width: int = WIDTH):
        self.width = width
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        used = np.bincount(data, minlength=256) > 0
        text[inside] = np.cumsum(used)[data]  # symbols in the order of the bytes, without gaps
        self.text, self.n = text, len(text)
        self.left = np.repeat(ends - 1, lengths + 1) - np.arange(len(text))  # bytes up to the separator
        self.bits = max(1, int(used.sum()).bit_length())
        self.symbols = 63 // self.bits  # in a word
        padded = np.concatenate([text, np.zeros(width + 2 * self.symbols, np.int64)])
        m = self.n + width + self.symbols
        self.word = np.zeros(m, np.int64)
        for j in range(self.symbols):
            self.word = (self.word << self.bits) | padded[j : j + m]
        self.order = self._induce(self._sorted_small())

    def _small(self) -> np.ndarray:
        """Whether each suffix is smaller than its successor; decided by the next different symbol."""
        t = self.text
        if not len(t):
            return np.zeros(0, bool)
        change = np.flatnonzero(t[1:] != t[:-1])
        rises = np.append(t[change] < t[change + 1], False)  # the last run is followed by nothing
        return np.repeat(rises, np.diff(np.concatenate([[-1], change, [self.n - 1]])))

    def _sorted_small(self) -> np.ndarray:
        """Stage one: direct sort of the suffixes smaller than their successors, some symbols at a time, within tied groups only."""
        self.small = self._small()
        at = np.flatnonzero(self.small)
        at = at[np.argsort(self.word[at])]
        value = self.word[at]
        tied = np.zeros(len(at), bool)
        tied[1:] = value[1:] == value[:-1]
        depth = self.symbols
        while depth < self.width + self.symbols:
            member = tied.copy()
            member[:-1] |= tied[1:]
            places = np.flatnonzero(member)  # groups of one are settled
            if not len(places):
                break
            group = np.cumsum(~tied[places])
            take = min((63 - int(group[-1]).bit_length()) // self.bits, self.symbols)
            sub = at[places]
            value = self.word[np.minimum(sub + depth, len(self.word) - 1)] >> (self.bits * (self.symbols - take))
            key = (group << (self.bits * take)) | value
            order = np.argsort(key)
            at[places] = sub[order]
            key = key[order]
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            tied[places] = same
            depth += take
        return at

    def _induce(self, small: np.ndarray) -> np.ndarray:
        """Stage two: one scan over the buckets of first symbols places all other suffixes before the bucket's small ones."""
        t = self.text
        first = t[small]
        cuts = np.searchsorted(first, np.arange(258))
        waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
        out = []

        def scan(found: np.ndarray, symbol: int) -> np.ndarray:
            """Deal the predecessors that are larger than their successors to their buckets; return those of this bucket."""
            before = found[found > 0] - 1
            before = before[~self.small[before]]
            symbols = t[before]
            own = before[symbols == symbol]
            before, symbols = before[symbols > symbol], symbols[symbols > symbol]
            order = np.argsort(symbols.astype(np.uint16), kind="stable")
            before, symbols = before[order], symbols[order]
            for i in np.split(np.arange(len(before)), np.flatnonzero(symbols[1:] != symbols[:-1]) + 1):
                if len(i):
                    waiting[symbols[i[0]]].append(before[i])
            return own

        if self.n and not self.small[self.n - 1]:
            waiting[t[self.n - 1]].append(np.array([self.n - 1]))  # the empty suffix comes first of all
        for symbol in range(257):
            wave = np.concatenate(waiting[symbol]) if waiting[symbol] else np.zeros(0, np.int64)
            while len(wave):
                out.append(wave)
                wave = scan(wave, symbol)
            directly = small[cuts[symbol] : cuts[symbol + 1]]
            if len(directly):
                out.append(directly)
                scan(directly, symbol)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def common(self) -> np.ndarray:
        """Whether each suffix shares its first `width` bytes with the one before it in the order."""
        a = self.order
        same = np.zeros(len(a), bool)
        live = np.flatnonzero((self.left[a[1:]] >= self.width) & (self.left[a[:-1]] >= self.width)) + 1
        step = min(self.symbols, self.width)
        for depth in [*range(0, self.width - step, step), self.width - step]:
            drop = self.bits * (self.symbols - step)
            live = live[self.word[a[live] + depth] >> drop == self.word[a[live - 1] + depth] >> drop]
        same[live] = True
        return same


def repeats(doc: np.ndarray, lo: np.ndarray, length: np.ndarray, data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every window whose bytes also start earlier among the given segments."""
    array = SuffixArray(data, length, width)
    same = array.common()
    a = array.order
    ids, rank = np.unique(doc, return_inverse=True)
    segment = np.repeat(np.arange(len(length)), length + 1)
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]]) if len(length) else length
    member = np.flatnonzero(same | np.append(same[1:], False)) if len(a) else a
    p = a[member]
    seg = segment[p]
    place = rank[seg] * 2**40 + lo[seg] + p - begin[seg]
    group = np.flatnonzero(~same[member])
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(place, group), np.diff(np.append(group, len(member))))
    later = np.unique(place[place > least])
    return ids[later >> 40], later & (2**40 - 1)


def pieces(key: np.ndarray, length: np.ndarray, limit: int):
    """Places of segments in runs of whole anchors, at most `limit` bytes each unless one anchor has more."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    total = np.concatenate([[0], np.cumsum(length[order])])
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(total[starts], total[starts[a]] + limit, "right")) - 1
        b = max(b, a + 1)
        yield order[starts[a] : starts[b] if b < len(starts) else len(order)]
        a = b


def sorted_out(lists: DataFrame) -> DataFrame:
    """Removed ranges: the given ones, and the places of equal windows by suffix sorting, all but the first of each group."""

    def run(table: pa.Table) -> pa.Table:
        columns, data, out = [np.zeros((4, 0), np.int64)], [np.zeros(0, np.uint8)], []
        for x in table.column("body"):
            body = x.as_py()
            n = int(np.frombuffer(body, np.int64, 1)[0])
            if n < 0:
                out.append(tuple(np.frombuffer(body, np.int64, -1, 8).reshape(3, -n)))
                continue
            numbers, part = read_bytes(body)
            columns.append(numbers)
            data.append(part)
        key, doc, lo, length = np.concatenate(columns, axis=1)
        data = np.concatenate(data)
        begin = np.cumsum(length) - length
        rolling = Rolling(32)
        content = np.zeros(len(key), np.uint64)
        for i in range(0, len(key), 20_000):  # fingerprints of bounded parts
            a, b = begin[i], begin[min(i + 20_000, len(key)) - 1] + length[min(i + 20_000, len(key)) - 1]
            s, e = begin[i : i + 20_000] - a, begin[i : i + 20_000] + length[i : i + 20_000] - a
            content[i : i + 20_000] = rolling.spans(rolling.prefix(data[a:b]), s, e)
        first, later = representatives(key, content, doc, lo, data, begin, length)
        out.append(merged(doc[later], lo[later], lo[later] + length[later]))
        key, doc, lo, length, begin = (x[first] for x in (key, doc, lo, length, begin))
        for i in pieces(key, length, PIECE):
            found, at = repeats(doc[i], lo[i], length[i], gather(data, begin[i], length[i]))
            out.append(merged(found, at, at + WIDTH))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["doc", "lo", "hi"])

    return lists.groupBy("bucket").applyInArrow(run, "doc long, lo long, hi long")


def removed_ranges(docs: DataFrame) -> DataFrame:
    """doc, lo, hi: byte ranges to remove (they may overlap)."""
    spark = docs.sparkSession
    size = total_bytes(docs)
    names = even_keys(spark, bucket_count(spark, size / 3))
    limit = max(HOT, size // ((2 * WIDTH - GRAM) // 4) // HOT_KEYS)
    told = materialise(recurring(meeting(docs, names), limit))
    hot = told.filter("doc IS NULL").orderBy(F.desc("contents"), "hot").limit(HOT_KEYS).select("hot").collect()
    told = told.filter("doc IS NOT NULL").select("doc", "keys")
    hot = np.sort(np.array([r.hot for r in hot], np.int64).view(np.uint64))
    if len(hot):
        more = materialise(recurring(meeting(docs, names, hot), 2**62))
        told = told.union(more.select("doc", "keys"))
    names = even_keys(spark, bucket_count(spark, 2 * size))
    return materialise(sorted_out(sending(docs, told, hot, names)))


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, number removed, number of removed runs)."""
    _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
    parts, last = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        parts.append(text[last:a])
        last = b
    parts.append(text[last:])
    return b"".join(parts), int((hi - lo).sum()), len(lo)


def deduplicate(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary: cuts may split characters)."""
    ranges = removed_ranges(docs).groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    rows = rows.join(ranges.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "lo", "hi")

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            raw, out = data.tobytes(), []
            los, his = rows.column(2), rows.column(3)
            for i in range(len(rows)):
                text = raw[offsets[i] : offsets[i + 1]]
                lo, hi = (np.asarray(x[i].values if x[i].is_valid else [], np.int64) for x in (los, his))
                kept, gone, spans = cut(text, lo, hi)
                out.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns][: 5 + keep_text], names=names[: 5 + keep_text])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"), keep_text=False)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * WIDTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {WIDTH - 1})) AS i FROM d WHERE n >= {WIDTH})),
gone AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WIDTH} THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {WIDTH} AS b FROM numbered GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s, a AS e FROM runs
  UNION ALL SELECT runs.doc_id, max(b), any_value(n) FROM runs JOIN d USING (doc_id) GROUP BY runs.doc_id
), text_ AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN text_ ON d.doc_id = text_.doc_id LEFT JOIN sums ON d.doc_id = sums.doc_id
"""
