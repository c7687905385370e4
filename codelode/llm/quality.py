"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Every whole text becomes a short vector of statistics (byte classes, words,
lines, repeated lines).  Random Fourier features of the standardised vector
approximate a Gaussian kernel; each partition sums its own part of the normal
equations, and the solved ridge gives raw scores.  A fifth of the training rows,
left out of the fit, gives the monotone map from raw scores to probabilities
(pool adjacent violators over counts in fixed bins).

Rows to learn from: labelled rows whose crc32(doc_id as text) mod 5 is not 0; of
these at most TRAIN_ROWS, those of least hash of doc_id.  Only their texts are looked
at for learning, so every other text is read and scored once.  Nothing but the text
enters a score.  What reaches the driver has a fixed size.

Defined results: null text scores as the empty text; a null doc_id is never
learned from; labels that are null or have no document are ignored; of repeated
labels of a document the highest counts; repeated rows get the same score; without labels of both kinds the score is the
share of label 1 (0.5 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, lean, materialise, read, text_blocks, texts, tune

FOURIER, RIDGE, WIDTH, BINS = 256, 1e-3, 0.15, 2000
#: A row is predicted good from this score on.
CUT = 0.3
#: Most rows to learn from.
TRAIN_ROWS = 200_000
#: Sums of partitions meet in so many groups, these in so many, before they reach the driver.
GROUPS = (1024, 32)
CLASSES = 12


def _byte_classes() -> np.ndarray:
    """A class for each byte; continuation bytes are the last class and count as no character."""
    out = np.full(256, 8, np.uint8)
    kinds = [" \t\v\f\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"-()", "!?", "#*$%&|<>@~^_=+\\/[]{}`"]
    for i, chars in enumerate(kinds):
        out[[ord(c) for c in chars]] = i
    out[0x80:0xC0] = 11
    out[0xC0:0xC4] = 9
    out[0xC4:] = 10
    return out


N_FEATURES = 11 + 13


def features(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, rolling: Rolling) -> np.ndarray:
    """One row of statistics for each text of a block."""
    n, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    kind = classes[data]
    counts = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    chars = np.maximum(counts[:, :11].sum(1), 1)
    space = kind < 2
    begins = ~space & np.concatenate([[True], space[:-1]]) if len(data) else np.zeros(0, bool)
    if len(data):
        first = offsets[:-1][size > 0]
        begins[first] = ~space[first]
    start = np.flatnonzero(begins)
    stop_mark = space.copy()
    stops = np.append(np.flatnonzero(stop_mark), len(data))
    end = np.minimum(stops[np.searchsorted(stops, start)], offsets[1:][of[start]]) if len(start) else start
    word_of, length = of[start], end - start
    words = np.bincount(word_of, minlength=n).astype(float)
    w1 = np.maximum(words, 1)
    mean = lambda values: np.bincount(word_of, values, minlength=n) / w1
    last = kind[end - 1] if len(start) else np.zeros(0)
    head = kind[start] if len(start) else np.zeros(0)
    line_start = np.unique(np.concatenate([offsets[:-1][size > 0], np.flatnonzero(kind == 1) + 1])) if len(data) else np.zeros(0, np.int64)
    line_start = line_start[line_start < len(data)]
    line_of = of[line_start]
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[1:][line_of]) if len(line_start) else line_start
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    prefix = rolling.prefix(data)
    mark = rolling.spans(prefix, line_start, line_end)
    order = np.lexsort((mark, line_of))
    word = rolling.spans(prefix, start, end)
    twin = np.flatnonzero((word[1:] == word[:-1]) & (word_of[1:] == word_of[:-1]))
    again = (mark[order][1:] == mark[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    repeated = np.bincount(line_of[order][1:][again], minlength=n)
    return np.column_stack(
        [
            np.log1p(100 * counts[:, :11] / chars[:, None]),
            np.log1p(words),
            np.log1p(mean(length)),
            np.log1p(100 * mean(length == 1)),
            np.log1p(100 * mean(length > 15)),
            np.log1p(100 * mean(last == 7)),
            np.log1p(100 * mean((last == 5) | (last == 6))),
            np.log1p(100 * mean(head == 3)),
            np.log1p(100 * mean((length == 1) & (head == 7))),
            np.log1p(100 * repeated / lines),
            np.log1p(words / lines),
            np.log1p(100 * counts[:, 3] / np.maximum(counts[:, 2] + counts[:, 3], 1)),
            np.log1p(lines),
            np.log1p(100 * np.bincount(word_of[twin], minlength=n) / w1),
        ]
    )


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    """False for a null doc_id: such rows are neither learned from nor held out."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False)).alias("held_out")


class Model:
    """Standardisation, Fourier features, ridge weights, calibration; all of fixed size."""

    def __init__(self):
        rng = np.random.default_rng(20)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.spin = rng.normal(0, WIDTH, (N_FEATURES, FOURIER))
        self.shift = rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + 1)
        self.levels = np.full(BINS, 0.5)

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale) @ self.spin + self.shift) * np.sqrt(2 / FOURIER)
        return np.column_stack([z, np.ones(len(x))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        raw = self.map(x) @ self.weights
        return np.clip(((raw + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.levels[self.bins(x)], 6)


def partition_sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum of of(x, y) over all rows (x packed, y double): by partition, then level by level in GROUPS groups, then on the driver."""

    @lean
    def part(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), float).reshape(len(batch), -1)
                total += of(x, np.asarray(batch.column(1), float)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "total"])

    @lean
    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in table.column("total").to_pylist():
            total += np.frombuffer(x, float)
        return pa.table({"g": table.column("g").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("x", "y").mapInArrow(part, "g int, total binary")
    for groups in GROUPS:
        sums = sums.withColumn("g", F.col("g") % groups).groupBy("g").applyInArrow(merge, "g int, total binary")
    return sum((np.frombuffer(r.total, float) for r in sums.collect()), np.zeros(size))


def pool(weight: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic levels of the bins (pool adjacent violators); empty bins take the level below, at the start above."""
    stack: list[list[float]] = []
    for i in np.flatnonzero(weight):
        stack.append([good[i], weight[i], i])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            g, w, _ = stack.pop()
            stack[-1][0] += g
            stack[-1][1] += w
    starts = np.array([s[2] for s in stack], int)
    levels = np.array([(s[0] + 0.5) / (s[1] + 1.0) for s in stack])
    levels = np.maximum.accumulate(levels)
    return levels[np.maximum(np.searchsorted(starts, np.arange(len(weight)), "right") - 1, 0)]


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> DataFrame:
    """x (statistics as packed doubles), y and aside (left out of the fit) of the rows to learn from; their labels go to the texts, not the texts to them."""
    marks = labels.filter(F.col(label).isin(0, 1) & (remainder() != 0)).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__doc"), "y")
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc")).select("text", "y", (F.xxhash64("doc_id", F.lit(7)) % 5 == 0).alias("aside"))

    @lean
    def run(batches):
        classes, rolling = _byte_classes(), Rolling(5)
        for block, data, offsets in text_blocks(batches):
            x = features(data, offsets, classes, rolling)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), block.column(1), block.column(2)], names=["x", "y", "aside"])

    tune(docs.sparkSession)
    return rows.mapInArrow(run, "x binary, y double, aside boolean")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Train on the labelled rows whose remainder is not 0."""
    rows = materialise(training_rows(docs, labels, label))
    model = Model()
    k, d = N_FEATURES, FOURIER + 1
    moments = partition_sums(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * k)
    n, good = moments[:2]
    if n == 0 or good in (0, n):
        model.levels[:] = good / n if n else 0.5
        return model
    model.mean = moments[2 : 2 + k] / n
    model.scale = np.sqrt(np.maximum(moments[2 + k :] / n - model.mean**2, 1e-6))

    def normal(x, y):
        z = model.map(x)
        w = np.where(y > 0, n / good, n / (n - good)) / 2
        return np.vstack([z.T @ (z * w[:, None]), (z * w[:, None]).T @ y])

    total = partition_sums(rows.filter("not aside"), normal, (d + 1) * d).reshape(d + 1, d)
    model.weights = np.linalg.solve(total[:d] + RIDGE * np.trace(total[:d]) / d * np.eye(d), total[d])

    def histogram(x, y):
        b = model.bins(x)
        return np.vstack([np.bincount(b, minlength=BINS), np.bincount(b, y, minlength=BINS)])

    counts = partition_sums(rows.filter("aside"), histogram, 2 * BINS).reshape(2, BINS)
    if counts[0].sum():
        model.levels = pool(*counts)
    else:
        model.levels[:] = good / n
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    @lean
    def run(batches):
        classes, rolling = _byte_classes(), Rolling(5)
        for rows, data, offsets in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(features(data, offsets, classes, rolling)))], names=["doc_id", "score"])

    tune(docs.sparkSession)
    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with all their columns; texts are not moved."""
    model = fit(docs, labels)

    @lean
    def run(batches):
        classes, rolling = _byte_classes(), Rolling(5)
        for rows, data, offsets in text_blocks(batches):
            yield rows.filter(pa.array(model.score(features(data, offsets, classes, rolling)) >= CUT))

    tune(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
