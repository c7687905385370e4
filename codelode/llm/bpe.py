"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts each text into chunks whose edges depend only on nearby
bytes, so texts that share a passage share its chunks.  A chunk is encoded once
for as long as a worker's bounded cache keeps it.  Ids near a chunk edge may be
wrong (the edge may fall inside a word), so every join is repaired: the span
from the last agreed boundary of the left chunk to the first of the right one is
encoded anew.  A boundary is agreed when a non-space ASCII byte is followed by a
space or a line feed, where the split pattern must start a piece whatever stands
on either side, and when the chunk's own ids end a token exactly there.  Where a
chunk has no agreed boundary the span widens over it, up to the whole text.

Defined results: null text is the empty text (no ids); special-token strings in
a text become their ids, as the library does by default; repeated rows give
repeated rows; every other input column is ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Rolling, lean, read, text_blocks, texts, tune

#: The split pattern of byte-level BPE tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: One edge in so many bytes on average (a power of two), and the bytes that decide it.
CHUNK_BYTES, EDGE_WINDOW = 512, 24
#: Bytes of chunk text and ids that a worker's cache holds in each of its two generations.
CACHE_BYTES = 24 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes as."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only vocabularies of plain byte-level BPE, without a normaliser, are encoded as their library does")
        letters = byte_letters()
        vocabulary = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if all(c in letters for c in piece)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {piece: i for piece, i in vocabulary.items() if i not in self.special.values()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [ranks[bytes(letters[c] for c in a + b)] for a, b in pairs]
        if order != sorted(order):
            raise ValueError("the merges of this vocabulary are not in the order of its ids")
        self.core = tiktoken.Encoding("codelode", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        pieces = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for piece, i in ranks.items():
            pieces[i] = piece
        for piece, i in self.special.items():
            pieces[i] = piece.encode()
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.rolling = Rolling(11)
        self.chunk_bytes, self.cache_bytes = chunk_bytes, cache_bytes
        self.young, self.old, self.held = {}, {}, 0
        self.encoded = self.reused = 0

    def _piece(self, raw: bytes) -> np.ndarray:
        return np.array(self.core.encode_ordinary(raw.decode("utf-8")), np.uint32)

    def _known(self, raw: bytes):
        """Ids of a chunk, with its first and last agreed boundary as (byte, token) places."""
        hit = self.young.get(raw)
        if hit is not None:
            self.reused += 1
            return hit
        hit = self.old.get(raw)
        if hit is None:
            self.encoded += 1
            ids = self._piece(raw)
            ends = np.cumsum(self.length[ids])
            a = np.frombuffer(raw, np.uint8)
            after = (a[1:] == 0x20) | (a[1:] == 0x0A)
            edges = np.flatnonzero(after & (a[:-1] > 0x20) & (a[:-1] < 0x7F)) + 1
            if len(edges):
                at = np.searchsorted(ends, edges)
                edges, at = edges[ends[at] == edges], at[ends[at] == edges] + 1
            hit = (ids, int(edges[0]), int(at[0]), int(edges[-1]), int(at[-1])) if len(edges) else (ids, -1, -1, -1, -1)
        else:
            self.reused += 1
        self.held += len(raw) + 4 * len(hit[0]) + 200
        if self.held > self.cache_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[raw] = hit
        return hit

    def _join(self, raw: bytes, edges: list[int]) -> list[np.ndarray]:
        if len(edges) == 2:
            return [self._known(raw)[0]]
        out, open_at = [], 0  # open_at: where the bytes not yet covered begin
        last = len(edges) - 2
        for k in range(last + 1):
            ids, f, fi, l, li = self._known(raw[edges[k] : edges[k + 1]])
            if k == 0:
                f, fi = (0, 0) if l >= 0 else (-1, -1)
            elif k == last and f >= 0:
                l, li = edges[-1] - edges[k], len(ids)
            if f < 0:
                continue
            if edges[k] + f > open_at:
                out.append(self._known(raw[open_at : edges[k] + f])[0])
            out.append(ids[fi:li])
            open_at = edges[k] + l
        if open_at < len(raw):
            out.append(self._known(raw[open_at:])[0])
        return out

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a block of UTF-8 bytes."""
        prefix = self.rolling.prefix(data)
        hashes = self.rolling.windows(prefix, EDGE_WINDOW)
        edges = np.flatnonzero((hashes >> np.uint64(40)) & np.uint64(self.chunk_bytes - 1) == 0) + EDGE_WINDOW
        edges = edges[edges < len(data)]
        edges = edges[(data[edges] & 0xC0) != 0x80]
        raw, out = data.tobytes(), []
        special = [s.encode() for s in self.special]
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            text = raw[a:b]
            if any(s in text for s in special):
                out.append(self._with_special(text))
            elif not text:
                out.append(np.zeros(0, np.uint32))
            else:
                own = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b, "left")]
                parts = self._join(text, [0, *(own - a).tolist(), b - a])
                out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out

    def _with_special(self, text: bytes) -> np.ndarray:
        """The first special string of the text (the longest of several there) becomes its id; what lies between is encoded apart."""
        parts = []
        while True:
            found = min(((text.find(s.encode()), -len(s), s) for s in self.special if s.encode() in text), default=None)
            at = len(text) if found is None else found[0]
            parts.append(self.encode_block(np.frombuffer(text[:at], np.uint8), np.array([0, at]))[0])
            if found is None:
                return np.concatenate(parts)
            parts.append(np.array([self.special[found[2]]], np.uint32))
            text = text[at + len(found[2].encode()) :]

    def encode(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        return self.encode_block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        n = self.length[ids]
        ends = np.cumsum(n)
        take = np.arange(int(ends[-1]) if len(ids) else 0) + np.repeat(self.place[ids] - (ends - n), n)
        return self.pieces[take].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and its ids as array<int>."""

    @lean
    def run(batches):
        codec = Codec(path)
        for rows, data, offsets in text_blocks(batches, text):
            found = codec.encode_block(data, offsets)
            ids = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), ids], names=[id_column, "ids"])

    tune(docs.sparkSession)
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The inverse of encode: id and text; null ids decode to the empty text."""

    @lean
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(x) for x in batch.column(1).fill_null([]).to_pylist()] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    tune(tokens.sparkSession)
    return tokens.select(id_column, ids).mapInArrow(run, f"`{id_column}` {tokens.schema[id_column].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; count and digests of both, without moving the ids."""

    @lean
    def run(batches):
        codec = Codec(path)
        for rows, data, offsets in text_blocks(batches):
            found = codec.encode_block(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    tune(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary())
