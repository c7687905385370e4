"""Toxicity classifier with counterfactual regularisation.

A text is the set of its words and of their beginnings of 3 to 6 bytes, lower
case.  Logistic regression over the features that go with the label is fitted
with two penalties: the usual one on the weights, and one on what swapping an
identity term changes.  Every sentence of the training rows is rewritten:
* a sentence that names a group, with each other term of its kind;
* any sentence, with the neutral word of each kind in the place of one of its words
  (the one of least fingerprint), and then with each other term there.
The squared change of the score, summed over all rewritten sentences, is
penalised.  Merely naming a group then adds nothing to a score.  Terms are those of
four languages; which language a row is in is not asked.

Rows to learn from: labelled rows whose crc32(doc_id as text) mod 5 is not 0; of
these at most TRAIN_ROWS, those of least hash of doc_id.  The model has at most
MAX_FEATURES weights; nothing else reaches the driver but sums by feature, the
selected features of the training rows, and the penalty, summed by the workers for
each pair of features that a swap changes together (at most what the list of terms
has, whatever the number of rows).

Defined results: null text scores as the empty text; null labels and labels
without a document are ignored; repeated rows get the same score; without labels
of both kinds every score is the share of label 1 (0 without labels); an empty
table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, read, text_blocks, texts, tune
from .quality import held_out, remainder

TRAIN_ROWS, MAX_FEATURES = 30_000, 4096
#: A feature is selected if so many toxic training rows have it and it stands out by so many standard deviations.
LEAST_ROWS, LEAST_Z = 4, 4.0
RIDGE, CALIBRATION_RIDGE, FAIRNESS, STEPS = 0.05, 0.1, 5.0, 150
PREFIXES = (3, 4, 5, 6)
CUT = 0.5

# Identity terms by language and kind; the first of each kind is the neutral word.
IDENTITY = {
    "en people": "people men women boys girls teenagers elders immigrants refugees foreigners",
    "en person": "person man woman boy girl immigrant refugee foreigner teenager",
    "en faith": "believers christians muslims jews hindus buddhists sikhs atheists catholics protestants",
    "en faithful": "religious christian muslim jewish hindu buddhist sikh atheist catholic protestant",
    "en origin": "local black white asian african european american latino arab indian chinese mexican",
    "en orientation": "married gay lesbian bisexual straight transgender queer",
    "en ability": "healthy disabled blind deaf autistic",
    "fr people": "gens hommes femmes garçons filles adolescents immigrés réfugiés étrangers",
    "fr person": "personne homme femme garçon fille immigré réfugié étranger",
    "fr faith": "croyants chrétiens musulmans juifs hindous bouddhistes athées catholiques protestants",
    "fr origin": "local noir blanc asiatique africain européen américain arabe indien chinois mexicain",
    "fr orientation": "marié gay lesbienne bisexuel hétérosexuel transgenre homosexuel",
    "fr ability": "valide handicapé aveugle sourd autiste",
    "de people": "leute männer frauen jungen mädchen jugendliche einwanderer flüchtlinge ausländer",
    "de person": "person mann frau junge mädchen einwanderer flüchtling ausländer",
    "de faith": "gläubige christen muslime juden hindus buddhisten atheisten katholiken protestanten",
    "de origin": "einheimisch schwarz weiß asiatisch afrikanisch europäisch amerikanisch arabisch indisch chinesisch mexikanisch",
    "de orientation": "verheiratet schwul lesbisch bisexuell heterosexuell transgender queer",
    "de ability": "gesund behindert blind taub autistisch",
    "es people": "gente hombres mujeres chicos chicas adolescentes inmigrantes refugiados extranjeros",
    "es person": "persona hombre mujer chico chica inmigrante refugiado extranjero",
    "es faith": "creyentes cristianos musulmanes judíos hindúes budistas ateos católicos protestantes",
    "es origin": "local negro blanco asiático africano europeo americano árabe indio chino mexicano",
    "es orientation": "casado gay lesbiana bisexual heterosexual transgénero homosexual",
    "es ability": "sano discapacitado ciego sordo autista",
}
SENTENCE = np.zeros(256, bool)
SENTENCE[[ord(c) for c in ".!?\n"]] = True


class Reader:
    """Features of words as 64-bit fingerprints of bytes."""

    def __init__(self):
        self.rolling = Rolling(91)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.inside = np.zeros(256, bool)
        self.inside[48:58] = self.inside[65:91] = self.inside[97:123] = self.inside[128:] = True

    def fold(self, data: np.ndarray) -> np.ndarray:
        """Lower case for ASCII and for the accented letters of Latin-1."""
        a = self.lower[data]
        if len(a) > 1:
            second = np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)) + 1
            a[second] += 0x20
        return a

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """(fingerprints by feature kind, text number, start) of every word; the last kind is the whole word."""
        a = self.fold(data)
        ok = self.inside[a]
        cut = np.zeros(len(a) + 1, bool)
        cut[offsets] = True
        start = np.flatnonzero(ok & (np.concatenate([[True], ~ok[:-1]]) | cut[:-1])) if len(a) else np.zeros(0, np.int64)
        end = np.flatnonzero(ok & (np.concatenate([~ok[1:], [True]]) | cut[1:])) + 1 if len(a) else start
        prefix = self.rolling.prefix(a)
        marks = [self.rolling.spans(prefix, start, np.minimum(end, start + k)) ^ np.uint64(k) for k in PREFIXES]
        return [*marks, self.rolling.spans(prefix, start, end)], np.searchsorted(offsets, start, "right") - 1, start

    def word(self, word: str) -> list[int]:
        """All features of one word."""
        data = np.frombuffer(word.encode(), np.uint8)
        marks, _, _ = self.words(data, np.array([0, len(data)]))
        return [int(m[0]) for m in marks]

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature)."""
        marks, of, _ = self.words(data, offsets)
        key, of = np.concatenate(marks), np.tile(of, len(marks))
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        return of[new], key[new]


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, y of the rows to learn from."""
    marks = labels.filter(F.col(label).isin(0, 1) & (remainder() != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__doc"), "y")
    return texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc")).select("doc_id", "text", "y")


def select_features(rows: DataFrame, n1: int, n0: int, buckets: int = 32) -> np.ndarray:
    """Fingerprints of the features that go with the label, at most MAX_FEATURES of the strongest."""

    def count(batches):
        reader, held = Reader(), []

        def packed():
            key = np.concatenate([h[0] for h in held])
            y = np.concatenate([h[1] for h in held])
            keys, at = np.unique(key, return_inverse=True)
            a, b = np.bincount(at, y, minlength=len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
            to = (keys >> np.uint64(59)).astype(int)
            for k in np.unique(to):
                i = to == k
                yield int(k), np.concatenate([keys[i].view(np.int64), a[i], b[i]]).tobytes()

        def flush():
            out = list(packed())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "body"])

        size = 0
        for block, data, offsets in text_blocks(batches):
            of, key = reader.sets(data, offsets)
            held.append((key, np.asarray(block.column(2))[of]))
            size += len(key)
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def choose(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.int64).reshape(3, -1) for x in table.column("body")]
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        a = np.bincount(at, np.concatenate([p[1] for p in parts]))
        b = np.bincount(at, np.concatenate([p[2] for p in parts]))
        share = b / (n1 + n0)
        z = (a / n1 - (b - a) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        ok = np.flatnonzero((a >= LEAST_ROWS) & (z >= LEAST_Z))
        ok = ok[np.lexsort((keys[ok], -z[ok]))][:MAX_FEATURES]
        return pa.table({"key": pa.array(keys[ok]), "z": pa.array(z[ok])})

    strong = rows.mapInArrow(count, "bucket int, body binary").groupBy("bucket").applyInArrow(choose, "key long, z double")
    chosen = strong.orderBy(F.desc("z"), "key").limit(MAX_FEATURES).collect()
    return np.sort(np.array([r.key for r in chosen], np.int64).view(np.uint64))


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve from raw scores to the label (Newton steps).

    The ridge on the slope keeps the curve from stretching the tiny differences that the penalties leave."""
    x = np.column_stack([z, np.ones(len(z))])
    t, ridge = np.array([1.0, 0.0]), np.array([CALIBRATION_RIDGE, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (p - y) + ridge * t
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        t = t - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(t[0]), 0.0), float(t[1])


class Model:
    def __init__(self, keys: np.ndarray, prior: float):
        self.keys = np.sort(keys)
        self.weights = np.zeros(len(keys))
        self.bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        self.constant = prior if prior in (0.0, 1.0) else None
        self.rewritten = 0  # sentences that the penalty saw
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True

    def places(self, key: np.ndarray) -> np.ndarray:
        """Index of each feature in the model, -1 where it is not selected."""
        out = np.full(len(key), -1)
        maybe = np.flatnonzero(self.seen[key >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == key[maybe], at, -1)
        return out

    def selected(self, reader: Reader, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature index) of a block."""
        marks, of, _ = reader.words(data, offsets)
        pairs = [np.zeros(0, np.int64)]
        for m in marks:
            at = self.places(m)
            hit = np.flatnonzero(at >= 0)
            pairs.append(of[hit] * (len(self.keys) + 1) + at[hit])
        both = np.unique(np.concatenate(pairs))
        return both // (len(self.keys) + 1), both % (len(self.keys) + 1)

    def score(self, of: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        z = self.bias + np.bincount(of, self.weights[at], minlength=n)[:n]
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def fit(self, of: np.ndarray, at: np.ndarray, y: np.ndarray, fair: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Damped diagonal steps on the summed logistic loss with both penalties; fair: the penalty's matrix as (row, column, value)."""
        n, d = len(y), len(self.keys)
        if not d:
            return
        i, j, v = fair
        w, b = np.zeros(d), self.bias
        rate = np.bincount(at, minlength=d)
        bound = np.bincount(i, np.abs(v), minlength=d)
        active = np.bincount(of, minlength=n)
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(of, w[at], minlength=n), -30, 30)))
            r = p - y
            g = np.bincount(at, r[of], minlength=d) + RIDGE * w + FAIRNESS * np.bincount(i, v * w[j], minlength=d)
            # a bound on the curvature of each feature: diagonal steps need no dense matrix of the data
            h = np.bincount(at, (np.maximum(p * (1 - p), 0.02) * np.maximum(active, 1))[of], minlength=d) + RIDGE + FAIRNESS * bound
            w = np.maximum(w - g / np.maximum(h, 1e-9), 0)  # selected features speak for the label only
            b -= r.sum() / (0.25 * n)
        w[rate == 0] = 0
        z = b + np.bincount(of, w[at], minlength=n)
        slope, shift = calibrate(z, y)
        self.weights, self.bias = slope * w, slope * b + shift


class Swaps:
    """What swapping terms changes: selected features of every term, and the penalty's matrix summed over sentences."""

    def __init__(self, reader: Reader, model: Model):
        self.model = model
        self.terms: list[tuple[int, list[frozenset]]] = []  # fingerprint of a term; features of the terms of its kind, its own first
        self.places: dict[int, list[int]] = {}  # fingerprint: places in terms
        self.inserts: list[tuple[frozenset, frozenset]] = []
        for words in IDENTITY.values():
            marks = [reader.word(w) for w in words.split()]
            features = [frozenset(i for i in model.places(np.array(m, np.uint64)).tolist() if i >= 0) for m in marks]
            self.inserts += [(features[0], x) for x in features[1:]]
            for k, m in enumerate(marks):
                self.places.setdefault(m[-1], []).append(len(self.terms))
                self.terms.append((m[-1], [features[k], *features[:k], *features[k + 1 :]]))
        self.mine = np.zeros(len(model.keys) + 1, bool)  # features of any term; the last entry is for -1
        for _, features in self.terms:
            self.mine[list(features[0])] = True
        self.named_marks = np.array(list(self.places), np.uint64)
        self.carriers: Counter = Counter()
        self.named: Counter = Counter()

    def count(self, reader: Reader, data: np.ndarray, offsets: np.ndarray) -> None:
        """Count the sentences of a block by the term features that their other words have."""
        marks, of, start = reader.words(data, offsets)
        if not len(of):
            return
        breaks = np.cumsum(SENTENCE[data])
        sentence = breaks[start] + of * (int(breaks[-1]) + 2)
        begin = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        number = np.cumsum(np.concatenate([[0], sentence[1:] != sentence[:-1]]))
        least = np.minimum.reduceat(marks[-1], begin)
        replaced = np.full(len(begin), -1)
        hit = np.flatnonzero(marks[-1] == least[number])
        replaced[number[hit][::-1]] = hit[::-1]
        held: dict[int, list[tuple[int, int]]] = {}
        for m in marks:
            at = self.model.places(m)
            for w in np.flatnonzero(self.mine[at]).tolist():
                held.setdefault(int(number[w]), []).append((w, int(at[w])))
        self.carriers[()] += len(begin) - len(held)
        for s, pairs in held.items():
            self.carriers[tuple(sorted({i for w, i in pairs if w != replaced[s]}))] += 1
        for w in np.flatnonzero(np.isin(marks[-1], self.named_marks)).tolist():
            rest = tuple(sorted({i for x, i in held.get(int(number[w]), []) if x != w}))
            for k in self.places[int(marks[-1][w])]:
                self.named[k, rest] += 1

    def matrix(self) -> tuple[int, dict[tuple[int, int], float]]:
        """Rewritten sentences, and the sum of the outer products of what they change."""
        total: dict[tuple[int, int], float] = {}
        rewritten = 0

        def add(old: frozenset, new: frozenset, others: frozenset, times: int) -> None:
            change = [(i, -1) for i in old - new - others] + [(i, 1) for i in new - old - others]
            for i, a in change:
                for j, b in change:
                    total[i, j] = total.get((i, j), 0.0) + times * a * b

        for rest, times in self.carriers.items():
            rewritten += times * len(self.inserts)
            for old, new in self.inserts:
                if old or new:
                    add(old, new, frozenset(rest), times)
        for (k, rest), times in self.named.items():
            own, *others = self.terms[k][1]
            rewritten += times * len(others)
            for new in others:
                add(own, new, frozenset(rest), times)
        return rewritten, total


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    tune(docs.sparkSession)
    rows = training_rows(docs, labels, label)
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), 1.0 if n1 else 0.0)
    model = Model(select_features(rows, n1, n0), n1 / (n1 + n0))

    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("y", pa.int64()), ("body", pa.binary()), ("value", pa.float64())])

    def small(batches):
        reader = Reader()
        swaps = Swaps(reader, model)
        for block, data, offsets in text_blocks(batches):
            of, at = model.selected(reader, data, offsets)
            swaps.count(reader, data, offsets)
            cuts = np.searchsorted(of, np.arange(len(block) + 1))
            lists = [at[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            n = len(block)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), block.column(0), block.column(2).cast(pa.int64()), pa.array(lists, pa.binary()), pa.array([0.0] * n)], schema=schema)
        rewritten, total = swaps.matrix()
        bodies = [b"", *[np.array(k, np.int32).tobytes() for k in total]]
        n = len(bodies)
        yield pa.RecordBatch.from_arrays(
            [pa.array([2, *[1] * (n - 1)], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(bodies, pa.binary()), pa.array([float(rewritten), *total.values()])], schema=schema
        )

    found = rows.mapInArrow(small, "kind int, doc_id long, y long, body binary, value double").groupBy("kind", "doc_id", "body").agg(F.max("y").alias("y"), F.sum("value").alias("value")).collect()
    known = sorted((r for r in found if r.kind == 0), key=lambda r: (r.doc_id, bytes(r.body)))
    lists = [np.frombuffer(r.body, np.int32) for r in known]
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.concatenate(lists).astype(int) if lists else np.zeros(0, int)
    fair = sorted((bytes(r.body), r.value) for r in found if r.kind == 1)
    pairs = np.array([np.frombuffer(b, np.int32) for b, _ in fair], int).reshape(-1, 2)
    model.rewritten = int(sum(r.value for r in found if r.kind == 2))
    model.fit(of, at, np.array([r.y for r in known], float), (pairs[:, 0], pairs[:, 1], np.array([v for _, v in fair])))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        reader = Reader()
        for block, data, offsets in text_blocks(batches):
            of, at = model.selected(reader, data, offsets)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(model.score(of, at, len(block)))], names=["doc_id", "score"])

    tune(docs.sparkSession)
    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
