"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case.  Numbers, names (capitalised words)
and units become typed placeholders, so a question with other numbers or names
keeps its template.  Windows of template words are hashed on both sides and
joined by hash.  A capital says little at the start of a sentence and nothing in a
text of another case, so a window is hashed in up to four readings: with all
capitalised words as names; with those that begin a sentence as words; with all
names as words; and, where fewer than LITERAL words are no placeholder, word for
word.  A window of the text matches one of the benchmark if two of their readings
agree.

The join is checked on the words themselves: at every place both words are equal,
or both are placeholders of one type.  A changed name at the start of a sentence
must not be a common word (one that its own text also has in lower case).
Matches of a text and an item on one diagonal (equal shift) are one alignment.
Its slots are then checked: one value of the item must stand for one value of the
text throughout; other values of the item may stand for the same one.  Slots that
kept their value are verbatim text; changed slots whose item value stands for
several values of the text conflict, and windows holding them are discarded.  An
item is leaked where the windows left cover COVER of its words, or PASSAGE words
in all.

The texts are read once, whatever the size of the benchmark.  A bitmap of its
hashes (MAP_BITS bits, a fixed size) goes to the workers, so only windows that may
match leave them; the windows of the benchmark are a table and meet those by a
hash join.

Defined results: null texts and texts without words match nothing; items shorter
than a window are matched whole; items of fewer than SHORTEST words are matched
by texts that consist of them; rows of equal id and text are one document; items
with equal text are each reported; a null doc_id is reported as such; an empty
table on either side gives no match; other columns pass through clean().
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as digest

from .common import BUCKET_BYTES, lean, materialise, mix, read, text_blocks, texts, tune

WINDOW, SHORTEST, LITERAL = 8, 4, 3
#: Leaked: this share of the item's words, or so many of them.
COVER, PASSAGE = 0.5, 20
#: Bits of the bitmap of the benchmark's hashes (a power of two).
MAP_BITS = 1 << 26
#: Different words a worker remembers before it starts anew.
REMEMBERED = 250_000
#: Ids of leaking documents that may be sent to every executor (16 bytes each); beyond, they are joined by id.
BROADCAST_IDS = 500_000

# Words for numbers and units that templates abstract from.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty hundred thousand million billion half double".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers mph watt watts volt volts"
).split()
NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(?:e[+\-]?\d+)?%?")
NUMBER_UNIT = re.compile(r"[+\-]?\d[\d.,]*([a-zµ°]{1,3})")
NUM, NAME, UNIT, MEASURE = 1, 2, 3, 4
OUTER, ENDS = "\"'`.,;:!?()[]{}<>*_#&|~«»“”‘’¿¡-–—…", (".", "!", "?", ":")
#: Never inside a word, as words are split there.
BETWEEN = "\x1f"


class Words(dict):
    """Index of each different raw word into tables: template code (capitalised words as names), the same (as words), value, ends a sentence."""

    def __init__(self):
        super().__init__()
        self.numbers, self.units = set(NUMBER_WORDS), set(UNITS)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows: list[tuple[int, int, int, int]] = []  # not yet in the table
        self.table = np.zeros((0, 4), np.uint64)

    def kinds(self, word: str, low: str, value: int) -> tuple[int, int]:
        """Codes of a word without its outer punctuation: as a name where it has a capital; as a word."""
        if low[0] in "0123456789+-$€£":
            if NUMBER.fullmatch(low):
                return NUM, NUM
            if (m := NUMBER_UNIT.fullmatch(low)) and m[1] in self.units:
                return MEASURE, MEASURE
        if low in self.numbers:
            return NUM, NUM
        if low in self.units:
            return UNIT, UNIT
        return (NAME if word[0].isupper() else value), value

    def __missing__(self, raw: str) -> int:
        word = raw.strip(OUTER)
        low = word.casefold()
        self[raw] = place = len(self.table) + len(self.rows)
        if low:
            value = digest(low) | 16  # above the placeholders
            self.rows.append((*self.kinds(word, low, value), value, int(raw[-1] != word[-1] and raw.rstrip("\"')]»”’")[-1:] in ENDS)))
        else:
            self.rows.append((0, 0, 0, int(raw.rstrip("\"')]»”’")[-1:] in ENDS)))
        return place

    def templates(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """name reading, word reading, value, begins a sentence, text number and raw word of every word of the texts."""
        if len(self.table) > REMEMBERED:
            self.forget()
        parts = [t.split() for t in texts]
        index = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64)
        of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, np.uint64)])
            self.rows = []
        name, word, value, ends = self.table[index].T
        keep = value > 0
        first = np.ones(len(index), bool)
        first[1:] = (ends[:-1] > 0) | (of[1:] != of[:-1])
        at = np.flatnonzero(keep)
        return name[keep], word[keep], value[keep], first[keep], of[keep], (parts, at)


def raw_words(place: tuple, of: np.ndarray, size: int, text: int) -> list[str]:
    """The words of one text that templates() kept."""
    parts, at = place
    before = sum(len(p) for p in parts[:text])
    mine = at[np.searchsorted(of, text) : np.searchsorted(of, text, "right")] - before
    return [parts[text][i] for i in mine.tolist()]


def window_hashes(name, word, value, first, of, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that lie in one text, in all their readings."""
    n = len(of) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factor = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 2**64)) for j in range(width)]

    def hashed(kind: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(wanted)
        total = np.full(len(at), width, np.uint64)
        if 4 * len(at) > n:
            whole = np.full(n, width, np.uint64)
            for j in range(width):
                whole += kind[j : j + n] * factor[j]
            total = whole[at]
        else:
            for j in range(width):
                total += kind[at + j] * factor[j]
        return at, mix(total)

    def count(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark)])
        return sums[width:] - sums[:n]

    inside = of[:n] == of[width - 1 :]
    names = name == NAME
    enough = min(LITERAL, width - 1)
    begins = names & first
    mixed = np.where(begins, word, name)
    few = count(name >= 16) < enough
    readings = [
        (name, inside & ~few),
        (mixed, inside & (count(begins) > 0) & (count(mixed >= 16) >= enough)),
        (word, inside & (count(names & ~first) > 0) & (count(word >= 16) >= enough)),
        (value, inside & few),
    ]
    found = [hashed(kind, wanted) for kind, wanted in readings]
    return np.concatenate([a for a, _ in found]), np.concatenate([h for _, h in found])


def common_marks(words: list[str], first: np.ndarray) -> np.ndarray:
    """Whether each capitalised word that begins a sentence also occurs in lower case."""
    plain = [w.strip(OUTER) for w in words]
    lower = {w for w in plain if w[:1].islower()}
    return np.array([bool(f) and w[:1].isupper() and w.casefold() in lower for w, f in zip(plain, first.tolist(), strict=True)], bool)


WINDOWS = "hash long, doc_id long, h long, at long, n_words long, words string, common string"
WINDOWS_SCHEMA = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("n_words", pa.int64()), ("words", pa.string()), ("common", pa.string())])


def windows(docs: DataFrame, widths: list[int] | None, seen: np.ndarray | None) -> DataFrame:
    """One row per reading of every window (with seen: of those in the bitmap): its hash, document, place, words and which are common.

    Without widths each text has the one width that items have: WINDOW, or the whole text."""

    @lean
    def run(batches):
        vocabulary = Words()
        for rows, data, offsets in text_blocks(batches):
            raw = data.tobytes()
            block = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            name, word, value, first, of, place = vocabulary.templates(block)
            size = np.bincount(of, minlength=len(block))
            begin = np.cumsum(size) - size
            own = np.minimum(size, WINDOW)
            out = []
            for width in sorted(set(own.tolist()) - {0}) if widths is None else widths:
                at, hashes = window_hashes(name, word, value, first, of, width)
                if seen is not None:
                    bit = hashes >> np.uint64(64 - MAP_BITS.bit_length() + 1)
                    maybe = (seen[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                    at, hashes = at[maybe], hashes[maybe]
                fits = own[of[at]] == width if widths is None else (width >= SHORTEST) | (size[of[at]] == width)
                at, hashes = at[fits], hashes[fits]
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                known = -1
                for p, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    t = int(of[p])
                    if t != known:
                        known, b = t, int(begin[t])
                        mine = raw_words(place, of, int(size[t]), t)
                        common = common_marks(mine, first[b : b + int(size[t])])
                    q = p - b
                    out.append((h, t, q, int(size[t]), BETWEEN.join(mine[q : q + width]), "".join("c" if c else "." for c in common[q : q + width])))
            if out:
                take = pa.array([x[1] for x in out], pa.int64())
                columns = [pa.array([x[i] for x in out], pa.int64() if i < 4 else pa.string()) for i in (0, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([columns[0], rows.column(0).take(take), rows.column(2).take(take), *columns[1:]], schema=WINDOWS_SCHEMA)

    tune(docs.sparkSession)
    return texts(docs, F.xxhash64(F.col("text").cast("string")).alias("h")).mapInArrow(run, WINDOWS)


def bitmap(items: DataFrame) -> np.ndarray:
    """Which leading bits the hashes have, as 64-bit words; at most MAP_BITS / 64 rows reach the driver."""
    bits = MAP_BITS.bit_length() - 1
    rows = items.select(F.shiftrightunsigned("hash", 64 - bits).alias("b")).distinct()
    rows = rows.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("mask")).collect()
    out = np.zeros(max(MAP_BITS // 64, 1), np.uint64)
    out[[r.word for r in rows]] = np.array([r["mask"] for r in rows], np.int64).view(np.uint64)
    return out


def compatible(ours: list[str], theirs: list[str], common: str, their_common: str, vocabulary: Words) -> tuple[bool, list[tuple[int, str, str]]]:
    """Whether two windows agree word by word, and their slots as (place, value of the item, value of the text)."""
    slots = []
    for i, (a, b) in enumerate(zip(ours, theirs, strict=True)):
        x, y = a.strip(OUTER), b.strip(OUTER)
        low, other = x.casefold(), y.casefold()
        mine, its = vocabulary.kinds(x, low, 16)[0], vocabulary.kinds(y, other, 16)[0]
        if low != other and (mine != its or mine >= 16 or (mine == NAME and "c" in (common[i], their_common[i]))):
            return False, []
        if mine < 16:
            slots.append((i, low, other))
    return True, slots


def verdict(rows: list[tuple], size: int, vocabulary: Words) -> tuple[int, int, int] | None:
    """(words covered, slots, slots with another value) of one item in one document, or None; rows: (place in the text, in the item, words of both, common of both)."""
    diagonals: dict[int, dict[int, tuple]] = {}
    for p, q, theirs, ours, their_common, common in rows:
        diagonals.setdefault(p - q, {})[q] = (theirs, ours, their_common, common)
    covered, slot_places, changed_places = set(), set(), set()
    for found in diagonals.values():
        fits = {}
        for q, (theirs, ours, their_common, common) in found.items():
            ok, slots = compatible(ours.split(BETWEEN), theirs.split(BETWEEN), common, their_common, vocabulary)
            if ok:
                fits[q] = (ours.count(BETWEEN) + 1, [(q + i, a, b) for i, a, b in slots])
        stands: dict[str, set[str]] = {}
        for _, slots in fits.values():
            for _, a, b in slots:
                stands.setdefault(a, set()).add(b)
        for q, (width, slots) in fits.items():
            if all(a == b or len(stands[a]) == 1 for _, a, b in slots):
                covered.update(range(q, q + width))
                slot_places.update(i for i, _, _ in slots)
                changed_places.update(i for i, a, b in slots if a != b)
    if covered and len(covered) >= min(COVER * size, PASSAGE):
        return len(covered), len(slot_places), len(changed_places)
    return None


LEAKS = "doc_id long, h long, item_id long, n_covered long, item_words long, n_slots long, n_changed long"


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked (document, item); h is a hash of the document's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = materialise(windows(items, None, None).withColumn("width", F.size(F.split("words", BETWEEN))))
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    own = items.select("hash", F.col("doc_id").alias("item_id"), F.col("at").alias("item_at"), F.col("n_words").alias("item_words"), F.col("words").alias("own_words"), F.col("common").alias("own_common"), "width").distinct()
    theirs = windows(docs, widths, bitmap(items)).withColumn("width", F.size(F.split("words", BETWEEN)))
    found = materialise(theirs.join(own, ["hash", "width"]).select("doc_id", "h", "item_id", "at", "item_at", "item_words", "words", "own_words", "common", "own_common").distinct())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() * 400 // BUCKET_BYTES + 1)
    names = [x.split()[0] for x in LEAKS.split(", ")]

    @lean
    def run(table: pa.Table) -> pa.Table:
        vocabulary, groups = Words(), {}
        columns = [table.column(c).to_pylist() for c in ("doc_id", "h", "item_id", "item_words", "at", "item_at", "words", "own_words", "common", "own_common")]
        for row in zip(*columns, strict=True):
            groups.setdefault(row[:4], []).append(row[4:])
        out = []
        for (doc, h, item, size), rows in groups.items():
            if (got := verdict(rows, size, vocabulary)) is not None:
                out.append((doc, h, item, got[0], size, got[1], got[2]))
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(7)], names=names)

    return found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", "item_id"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked (doc_id, item_id): words covered, words of the item, slots, slots with another value."""
    return _leaks(docs, benchmark).drop("h")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    gone = materialise(_leaks(docs, benchmark).select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__h"))
    return docs.join(gone, same, "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
