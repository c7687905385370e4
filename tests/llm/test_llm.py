"""Operators of codelode.llm against brute force, round trips, SQL and edge cases."""

import collections
import ctypes
import hashlib
import re
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from codelode.llm import bpe, chat, decontam, line_dedup, ngram_join, quality, rules, suffix_dedup, toxicity, warc
from codelode.llm.common import Rolling, materialise
from codelode.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid long, `key` string, lines string, d string, score double, hit int"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "one two three",
    "One two three",
    "The cat sat on the mat and looked at the moon all night long.\nSecond line here.\n\nThird.",
    "The cat sat on the mat and looked at the moon all night long.\nSecond line here.\n\nThird.",
    LONG,
    LONG + "tail words differ here",
    "日本語のテキスト " * 60,
    "<|endoftext|>x<|endoftext|> y  z w",
    "don't we'll I'm 12345 ### $$$ \r\n\r\n   spaced   out   ",
    "a" * 3000,
]


def table(spark, texts, start=0):
    rows = [(i + start, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", len(t or ""), 1, "k", "l", "d", 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    docs = table(spark, TEXTS)
    return docs.union(docs.filter("doc_id = 6"))  # a repeated row


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def views(sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


# ---- 1: BPE


def test_bpe_equals_library(spark, edge):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    got = bpe.digests(edge, bpe.vocabulary()).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_refuses_other_vocabularies(tmp_path):
    import json

    spec = json.load(open(bpe.vocabulary()))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Codec(str(path))


def test_bpe_round_trip_and_small_chunks(spark, edge, empty):
    back = bpe.decode(bpe.encode(edge, bpe.vocabulary()), bpe.vocabulary())
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert all(r.text == texts[r.doc_id] for r in back.collect())
    assert bpe.digests(empty, bpe.vocabulary()).count() == 0
    large, small = bpe.Codec(bpe.vocabulary()), bpe.Codec(bpe.vocabulary(), chunk_bytes=4, cache_bytes=2000)
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = "".join(rng.choice(list("ab  \n\t'sé1.日,A "), rng.integers(0, 300)))
        want = large.core.encode_ordinary(text)
        assert small.encode(text).tolist() == want == large.encode(text).tolist()
    assert small.reused


# ---- 2: WARC


def test_warc_links_and_files(spark):
    page = '<html lang="en"><head><title>A &amp; B</title><meta charset="UTF-8"><script>x="<p>no</p>"</script></head><body><p>One<br>two</p><a href="/x?a=1&amp;b=2">go</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/1", page), (2, None, None), (1, "http://a/1", page)], "page_id long, url string, html string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 6
    meta, text = (next(r for r in rows if r.source_id == 1 and r.record_type == k) for k in ("metadata", "conversion"))
    assert text.block == "A & B\nOne\ntwo\ngo" and text.content_length == len(text.block)
    assert meta.refers_to == text.refers_to and meta.record_id != text.record_id
    assert "title: A & B\r\n" in meta.block and "outlink: /x?a=1&b=2\r\n" in meta.block and "charset: utf-8" in meta.block
    assert meta.source_payload_digest == warc.digest(page.encode()) and text.block_digest == warc.digest(text.block.encode())
    assert next(r for r in rows if r.source_id == 2 and r.record_type == "conversion").block == ""
    out = warc.members(warc.derive(warc.responses(pages))).collect()
    files = spark.createDataFrame([(bytearray(b"".join(r.member for r in out)),), (bytearray(b"WARC/1.1\r\nbroken"),), (None,)], "content binary")
    back = warc.read_records(files).collect()
    assert sorted((r.record_type, r.record_id, r.refers_to, r.body) for r in back) == sorted((r.record_type, r.record_id, r.refers_to, r.block) for r in rows)


def test_warc_edges(spark):
    rows = [(7, "http://a", "<p>" + "long text " * 50_000, "x", "y"), (None, None, "no tags < 3 & more", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, body string, record_id string")
    got = {(r.source_id, r.record_type): r.block for r in warc.derive(warc.responses(pages)).collect()}
    assert len(got) == 4 and len(got[7, "conversion"]) == 10 * 50_000 - 1 and got[None, "conversion"] == "no tags < 3 & more"
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_packed_buckets_spread_evenly(spark):
    from codelode.llm.common import even_keys, partitions

    n = partitions(spark)
    keys = spark.createDataFrame([(int(k),) for k in even_keys(spark)], "k int").repartition(n, "k")
    assert [len(p) for p in keys.rdd.glom().collect()] == [1] * n


def test_warc_reads_responses(spark):
    body = "HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    row = warc.read_records(spark.createDataFrame([(bytearray(record.encode()),)], "content binary")).first()
    assert (row.http_headers, row.body, row.record_id) == ("HTTP/1.1 200 OK\r\nX: y", "<p>hi</p>", "<urn:uuid:1>")


def test_warc_broken_files_and_missing_fields(spark):
    import gzip

    def record(n, body=b"x" * 2000):
        return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    whole = [gzip.compress(record(i, np.random.default_rng(i).bytes(3_000_000 if i == 1 else 500))) for i in range(3)]
    cut = whole[0] + whole[2][:-40]  # the last member ends early
    spoilt = bytearray(b"".join(whole))
    spoilt[len(whole[0]) + len(whole[1]) + 300] ^= 0xFF
    files = [b"".join(whole), cut, bytes(spoilt), record(7) + b"junk", record(8)[:-500], b"\x1f\x8bnonsense", b"", gzip.compress(record(4) + record(5))]
    ids = [[h["warc-record-id"][-2] for h, _ in warc.parse(f)] for f in files]
    assert ids == [["0", "1", "2"], ["0"], ["0", "1"], ["7"], [], [], [], ["4", "5"]]
    table_ = spark.createDataFrame([(bytearray(f),) for f in files], "content binary")
    assert warc.read_records(table_).count() == 9
    nothing = spark.createDataFrame([(1, None, None, None, None, None)], "source_id long, record_id string, target_uri string, warc_date string, http_headers string, body string")
    assert {r.record_type for r in warc.derive(nothing).collect()} == {"metadata", "conversion"}


def test_warc_hostile_pages_take_linear_time():
    import time

    n = 100_000
    pages = ["<script>" * n, "<!--" * n, "<a " * n, "<title>" * n, "<a href=x " * n + ">", "<meta " * n + ">", "<html " * n, "<p" * n, "<script>x</style>" * n, '<a href="' * n + ">", "<svg></svg" * n, "</script" * n + " " * n]
    began = time.time()
    for page in pages:
        warc.plain_text(page), warc.metadata_fields(page, "d", 1)
    assert time.time() - began < 20
    assert warc.plain_text("a<!-- x -->b<script>c</SCRIPT >d<style>e<p>f") == "a b de\nf"
    assert list(warc.links_of("<a class=b href='/1'><a name=q><A HREF=\"/2?a>b\">x</a><a href=/3>")) == ["/1", "/2?a>b", "/3"]


def test_warc_file_to_derivatives_to_file(spark):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-Rate: 100% é "
    payload, binary = "<title>Café</title><p>été</p>".encode("latin-1"), bytes(range(256))
    named = "sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"

    def record(kind, n, front, payload, more=""):
        block = front.encode("latin-1") + b"\r\n\r\n" + payload
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://a/{n}\r\nContent-Type: application/http;msgtype={kind}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    file = record("request", 0, "GET / HTTP/1.1", b"") + record("response", 1, http, payload) + record("response", 2, "HTTP/1.1 200 OK", binary, f"WARC-Payload-Digest: {named}\r\n")
    read = warc.read_records(spark.createDataFrame([(bytearray(file),)], "content binary"))
    rows = warc.derive(read).collect()
    assert len(rows) == 4 and len({r.source_id for r in rows}) == 2
    files = spark.createDataFrame([(bytearray(b"".join(r.member for r in warc.members(warc.derive(read)).collect())),)], "content binary")
    back = {(r.refers_to, r.record_type): r for r in warc.read_records(files).collect()}
    for n, paid, headers, size in ((1, warc.digest(payload), http, len(payload)), (2, named, "HTTP/1.1 200 OK", 256)):
        for kind in ("metadata", "conversion"):
            row = back[f"<urn:uuid:{n}>", kind]
            assert (row.source_payload_digest, row.source_headers) == (paid, headers)
        assert f"source-payload-digest: {paid}\r\nsource-length: {size}\r\n" in back[f"<urn:uuid:{n}>", "metadata"].body
    assert back["<urn:uuid:1>", "conversion"].body == "Café\nété" and "title: Café\r\n" in back["<urn:uuid:1>", "metadata"].body


# ---- 3: decontamination


def test_decontamination_finds_templates(spark, edge, empty):
    item = "A train with 12 cars leaves Paris at 9 and reaches Rome after 12 hours, how many cars arrive in Rome?"
    same = "A train with 30 cars leaves Madrid at 7 and reaches Oslo after 30 hours, how many cars arrive in Oslo?"
    mixed = "A train with 30 cars leaves Madrid at 7 and reaches Oslo after 31 hours, how many cars arrive in Bonn?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item)], "item_id long, text string")
    docs = table(spark, [f"intro words here. {item} more", f"Note: {same}", mixed, "nothing like it", None, item.upper()])
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(docs, bench).collect()}
    assert {k for k in got} >= {(0, 1), (0, 4), (1, 1), (1, 4)}
    assert got[0, 1].n_changed == 0 and got[1, 1].n_changed == 6
    assert not {k for k in got if k[0] in (2, 3, 4)}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} & {0, 1, 2, 3, 4} == {2, 3, 4}
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.find_leaks(edge, bench).count() == 0


def test_decontamination_finds_all_exact_passages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, u in items.items() if u in t}
    assert {(r.doc_id, r.item_id) for r in decontam.op3_decontamination(spark, SF).collect()} >= want


def test_decontamination_finds_other_cases(spark):
    items = [
        "A train with 12 cars leaves Paris at 9 and reaches Rome after 12 hours, how many cars arrive in Rome?",
        "Der Zug mit 12 Wagen verlässt den Bahnhof in der Langen Straße und erreicht nach 9 Stunden die Stadt Köln.",
    ]
    other = "a train with 30 cars leaves paris at 7 and reaches rome after 30 hours, how many cars arrive in rome?"
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    copies = [f(x) for x in items for f in (str.upper, str.lower, str.title)]
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(table(spark, [*copies, other]), bench).collect()}
    assert set(got) == {(d, d // 3) for d in range(len(copies))} | {(len(copies), 0)}
    assert all(got[d, d // 3].n_changed == 0 for d in range(len(copies))) and got[len(copies), 0].n_changed == 3


def test_decontamination_keeps_what_does_not_conflict(spark):
    item = "Tom has 5 apples and gives 3 pears to his friend, then buys 8 more plums at the market. How many pieces of fruit are left?"
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)).split()
    passage[10:10], passage[30:30] = ["of", "Anna"], ["with", "Anna"]
    long = " ".join(passage)
    far = "There are 6 dogs in the yard behind the old house near the quiet river bend where we used to play as children and later 6 cats came along too."
    bench = spark.createDataFrame(list(enumerate([item, long, far])), "item_id long, text string")
    docs = [
        item.replace("5", "4").replace("3", "4"),  # different values become equal
        long.replace("Anna", "Maria", 1),  # one of two mentions edited
        far.replace("6", "7", 1).replace("6", "9"),  # equal values become different
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(table(spark, docs), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2)}
    assert got[0, 0].n_changed == 2 and got[1, 1].n_covered >= 50 and got[2, 2].n_changed == 0


def test_decontamination_ignores_the_size_of_the_bitmap(spark, monkeypatch):
    want = sorted(map(tuple, decontam.op3_decontamination(spark, SF).collect()))
    monkeypatch.setattr(decontam, "MAP_BITS", 64)
    assert sorted(map(tuple, decontam.op3_decontamination(spark, SF).collect())) == want


def brute_words(text):
    """(word as read, type or None, folded, begins a sentence) of every word, by the rules of the docstring."""
    out, begins = [], True
    for raw in (text or "").split():
        word = raw.strip(decontam.OUTER)
        low = word.casefold()
        if low:
            unit = re.fullmatch(r"[+-]?[0-9][0-9.,]*([a-zµ°]{1,3})", low)
            if re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*(e[+-]?[0-9]+)?%?", low) or low in decontam.NUMBER_WORDS:
                kind = "number"
            elif unit and unit[1] in decontam.UNITS:
                kind = "measure"
            else:
                kind = "unit" if low in decontam.UNITS else "name" if word[0].isupper() else None
            out.append((word, kind, low, begins))
        begins = raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
    plain = {w for w, *_ in out if w[:1].islower()}
    return [(w, k, low, first, first and w[:1].isupper() and low in plain) for w, k, low, first in out]


def brute_readings(window):
    named = [f"<{k}>" if k else low for _, k, low, _, _ in window]
    mixed = [low if k == "name" and first else f"<{k}>" if k else low for _, k, low, first, _ in window]
    plain = [low if k == "name" else f"<{k}>" if k else low for _, k, low, *_ in window]
    need = min(3, len(window) - 1)
    full = lambda r: sum(not x.startswith("<") for x in r) >= need
    return {tuple(r) for r in (named, mixed, plain) if full(r)} | (set() if full(named) else {tuple(x[2] for x in window)})


def brute_leaks(docs, items):
    out = set()
    for (d, text), (i, item) in ((x, y) for x in docs for y in items):
        theirs, ours = brute_words(text), brute_words(item)
        width = min(len(ours), 8)
        if not width or (width < 4 and len(theirs) != width):
            continue
        shifts = collections.defaultdict(dict)
        for q in range(len(ours) - width + 1):
            mine = ours[q : q + width]
            for p in range(len(theirs) - width + 1):
                pairs = list(zip(mine, theirs[p : p + width], strict=True))
                fits = all(a[2] == b[2] or (a[1] and a[1] == b[1] and not (a[1] == "name" and (a[4] or b[4]))) for a, b in pairs)
                if fits and brute_readings(mine) & brute_readings([b for _, b in pairs]):
                    shifts[p - q][q] = [(q + k, a[2], b[2]) for k, (a, b) in enumerate(pairs) if a[1]]
        covered = set()
        for found in shifts.values():
            values = collections.defaultdict(set)
            for slots in found.values():
                for _, a, b in slots:
                    values[a].add(b)
            for q, slots in found.items():
                if all(a == b or len(values[a]) == 1 for _, a, b in slots):
                    covered |= set(range(q, q + width))
        if covered and (len(covered) >= 20 or 2 * len(covered) >= len(ours)):
            out.add((d, i, len(covered)))
    return out


PEOPLE = "Tom has 3 red apples. Anna takes 2 of them. Peter buys 5 more pears. Julia eats 4 of those plums. Karl sells 7 old books."


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    other = "Max has 9 red apples. Lisa takes 8 of them. Otto buys 6 more pears. Eva eats 1 of those plums. Ben sells 12 old books."
    items = [PEOPLE, "Anna 3 kg, Ben 5 kg, Carl 7 kg, Dora 9 kg", "Why?", "two words", "A short item here", "The boat with 20 seats leaves the pier at 9 and the crew counts 17 guests.", None]
    texts = [PEOPLE, other, PEOPLE.upper(), PEOPLE.lower(), "so: " + items[1], items[1].replace("Ben", "Bob"), "why?", "why not?", "Two words", "two words more"]
    texts += ["and a short item here or there", "The boat with 30 seats leaves the pier at 8 and the crew counts 30 guests.", "Boat The boat with 20 seats leaves the pier at 9 and the crew counts 17 guests.", None, ""]
    texts += ["Red apples. Max has 9 red apples. The takes 8 of them. the Otto buys 6 more pears.", PEOPLE.replace("Tom", "The").replace("Peter", "the")]
    for _ in range(60):
        words = str(rng.choice([PEOPLE, other, items[5], items[1]])).split()
        for _ in range(rng.integers(0, 5)):
            k = rng.integers(0, len(words))
            words[k] = str(rng.choice(["Tom", "7", "apples.", "the", "Boat", "kg", "9"]))
        texts.append(" ".join([*words[rng.integers(0, 6) :], *words[: rng.integers(0, 12)]]))
    docs, bench = table(spark, texts).repartition(4), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_covered) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == brute_leaks(list(enumerate(texts)), list(enumerate(items)))
    assert {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (6, 2), (8, 3), (10, 4), (11, 5)} <= {(d, i) for d, i, _ in got} and not {d for d, *_ in got} & {7, 9, 13, 14}
    twice = docs.union(docs.filter("doc_id = 0"))
    assert {(r.doc_id, r.item_id, r.n_covered) for r in decontam.find_leaks(twice, bench).collect()} == got
    assert sorted(r.doc_id for r in decontam.clean(twice, bench).collect()) == sorted(set(range(len(texts))) - {d for d, *_ in got})


# ---- 4: quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op4_quality_classifier(spark, sf).collect()}
    marks = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in marks if got[r.doc_id].held_out]
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(a == b for a, b in held) >= 0.93 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())


def test_quality_edges(spark, edge, empty):
    few = labels_of(spark, [(3, 1, 0), (4, 0, 1), (6, 1, 0), (8, 0, 0), (9, None, None), (999, 1, 1), (None, 1, 1)])
    assert quality.classify(edge, few).count() == len(TEXTS) + 1
    for marks in (few.limit(0), labels_of(spark, [(3, 1, 0), (4, 1, 0), (1, 1, 0)])):
        scores = {r.score for r in quality.classify(edge, marks).collect()}
        assert scores in ({0.5}, {1.0})
    assert quality.classify(empty, few).count() == 0
    assert quality.keep(edge, few).columns == edge.columns


def test_quality_model_equals_brute_force(spark):
    """The summed normal equations and the isotonic step against direct ones."""
    import zlib

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, marks)
    label = {r.doc_id: r.quality for r in marks.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    aside = {r.doc_id for r in docs.select("doc_id", (quality.F.xxhash64("doc_id", quality.F.lit(7)) % 5 == 0).alias("a")).collect() if r.a}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id in label)
    x = np.concatenate([quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), quality._byte_classes(), quality.Rolling(5)) for _, t in rows])
    y = np.array([label[d] for d, _ in rows], float)
    out = np.array([d in aside for d, _ in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0).clip(1e-3), rtol=1e-4)
    w = np.where(y > 0, len(y) / y.sum(), len(y) / (len(y) - y.sum())) / 2
    z = model.map(x)[~out]
    left = z.T @ (z * w[~out, None])
    want = np.linalg.solve(left + quality.RIDGE * np.trace(left) / len(left) * np.eye(len(left)), z.T @ (w[~out] * y[~out]))
    assert np.allclose(model.weights, want, rtol=1e-6, atol=1e-8)
    bins, good = model.bins(x[out]), y[out]
    for b in set(bins.tolist()):  # isotonic level: the largest over starts of the least mean over ends
        starts, ends = sorted({c for c in bins if c <= b}), sorted({c for c in bins if c >= b})
        level = max(min(good[(bins >= s) & (bins <= e)].mean() for e in ends) for s in starts)
        block = [c for c in set(bins.tolist()) if model.levels[c] == model.levels[b]]
        held = np.isin(bins, block)
        assert good[held].mean() == pytest.approx(level) and model.levels[b] == pytest.approx((good[held].sum() + 0.5) / (held.sum() + 1), abs=0.02)


def test_isotonic_levels_rise():
    levels = quality.pool(np.array([0, 5, 5, 0, 10, 2]), np.array([0, 1, 0, 0, 9, 1]))
    assert (np.diff(levels) >= 0).all() and levels[0] == levels[1] == levels[2] == levels[3]


# ---- 5: suffix arrays


def brute_repeats(rows, width):
    seen, out = {}, set()
    for d, at, text in sorted((d, lo + i, t[i : i + width]) for d, lo, t in rows for i in range(len(t) - width + 1)):
        if seen.setdefault(text, (d, at)) != (d, at):
            out.add((d, at))
    return out


def test_two_stage_sort_and_common_prefixes():
    rng = np.random.default_rng(4)
    for _ in range(40):
        width = int(rng.integers(8, 30))
        rows = [(int(d), int(rng.integers(0, 4)), rng.integers(0, 3, rng.integers(0, 80)).astype(np.uint8).tobytes()) for d in range(rng.integers(1, 6))]
        size = np.array([len(t) for *_, t in rows])
        data = np.frombuffer(b"".join(t for *_, t in rows), np.uint8)
        array = suffix_dedup.SuffixArray(data, size, width)
        text = [tuple(array.text[i : i + width]) for i in array.order]
        assert sorted(array.order.tolist()) == list(range(array.n)) and text == sorted(text)
        got = suffix_dedup.repeats(np.array([d for d, *_ in rows]), np.array([lo for _, lo, _ in rows]), size, data, width)
        assert set(zip(*[x.tolist() for x in got], strict=True)) == brute_repeats(rows, width)


def brute_cut(rows, width=100):
    seen, out = set(), {}
    for d, text in sorted(rows):
        b = text.encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                mark[i : i + width] = True
            seen.add(b[i : i + width])
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        out[d] = (len(b), int(mark.sum()), int((mark & ~np.concatenate([[False], mark[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def planted(rng, n=60):
    pool = ["".join(rng.choice(list("abcdefgh "), 140)) for _ in range(4)]
    line = "this very common line is shorter than the width, but not by much; "
    texts = []
    for _ in range(n):
        parts = ["".join(rng.choice(list("abcdefgh "), rng.integers(0, 120))) for _ in range(3)]
        parts.insert(1, rng.choice([*pool, line, line, pool[0][20:125], "x" * 260]))
        texts.append("".join(parts))
    return texts + [texts[0], texts[0], texts[1] + "y", "é" * 200, ""]


@pytest.mark.parametrize("hot", [1, 3, 20000])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = planted(np.random.default_rng(hot))
    docs = table(spark, texts).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got == brute_cut(list(enumerate(texts)))


def test_suffix_dedup_cuts_long_texts_and_confirms_bytes(spark, monkeypatch):
    """Texts beyond PART are looked at in parts; fingerprints that collide decide nothing."""
    texts = planted(np.random.default_rng(9), 40)
    texts.append("".join(texts[:30]))
    monkeypatch.setattr(suffix_dedup, "PART", 300)
    docs = table(spark, texts).repartition(3)
    get = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()}
    assert get() == brute_cut(list(enumerate(texts)))
    key = np.zeros(4, np.uint64)
    data = np.frombuffer(b"aaaabbbbaaaabbbb", np.uint8)
    at, length = np.arange(4), np.full(4, 4)
    first, later = suffix_dedup.representatives(key, key, at, at * 0, data, at * 4, length)  # one fingerprint for all
    assert sorted(first.tolist()) == [0, 1] and sorted(later.tolist()) == [2, 3]


def test_suffix_dedup_hot_anchor(spark):
    """A line in more different contexts than HOT: its anchors' segments are split by their windows."""
    rng = np.random.default_rng(5)
    line = "all rights reserved by the publisher of these pages; no part may be copied, sold or lent without consent, ever"
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    texts = [f"{word()} {word()} {word()} {line} {word()} {word()}" for _ in range(2300)]
    monkeypatch = pytest.MonkeyPatch()
    monkeypatch.setattr(suffix_dedup, "HOT", 2000)
    docs = table(spark, texts).repartition(4)
    names = suffix_dedup.even_keys(spark, 8)
    hot = suffix_dedup.recurring(suffix_dedup.meeting(docs, names), 2000).filter("doc IS NULL").count()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()}
    monkeypatch.undo()
    assert hot > 0 and got == brute_cut(list(enumerate(texts)))


def test_suffix_dedup_edges(spark, edge, empty):
    got = suffix_dedup.deduplicate(edge).collect()
    assert len(got) == len(TEXTS) + 1
    want = brute_cut([(i, t or "") for i, t in enumerate(TEXTS)])
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.deduplicate(empty, keep_text=False).count() == 0


# ---- 6: quality rules


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics(spark, edge):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    extra = table(spark, ["a b c d e f g h x " * 2, "q\nq\n \nq", "p " * 40, "a b c d e f g h i a b c d e f g h j b c d e f g h i"], 100)
    texts = {r.doc_id: r.text for r in edge.union(extra).collect()}
    for r in rules.statistics(edge.union(extra)).collect():
        assert tuple(r[n] for n in names) == brute_rules(texts[r.doc_id]), texts[r.doc_id]


def test_rules_sql_and_edges(spark, edge, empty):
    got = sorted(map(tuple, rules.op6_quality_rules(spark, SF).collect()))
    assert got == sorted(views().execute(rules.ORACLE).fetchall())
    stats = materialise(rules.statistics(edge, keep=("doc_id", "lang")))
    marks = labels_of(spark, [(6, 1, 0), (6, 1, 0), (None, 1, 0), (7, None, 0)])
    assert rules.verdicts(stats, rules.thresholds(stats, marks)).count() == len(TEXTS) + 1
    none = materialise(rules.statistics(empty, keep=("doc_id", "lang")))
    assert rules.verdicts(none, rules.thresholds(none, marks)).count() == 0


def test_rules_reject_under_sql(spark):
    """Holdouts large enough to admit cutoffs: the thresholds reject, as in SQL."""
    sf = "/root/testdata/sf0.01"
    got = rules.quality_rules_high_risk(spark, sf)
    rows = sorted(tuple(r) for r in got.collect())
    cur = views(sf).execute(rules.HIGH_RISK_ORACLE)
    assert [d[0] for d in cur.description] == got.columns and rows == sorted(cur.fetchall())
    assert sum(not r.base_failed and not r.kept for r in got.collect()) > 20
    sf = "/root/testdata/sf0.1"
    found = sorted(map(tuple, rules.op6_quality_rules(spark, sf).select("doc_id", "base_failed", "kept").collect()))
    assert found == sorted(views(sf).execute(f"SELECT doc_id, base_failed, kept FROM ({rules.ORACLE})").fetchall())
    assert sum(not base and not kept for _, base, kept in found) > 100


def test_rule_holdouts_count_once(spark):
    """Repeated labels and rows are one piece of evidence; a null stratum is not the empty one; base rejections are counted."""
    good = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(i, good, None) for i in range(4)] + [(0, good, None)] + [(i, good, "") for i in range(10, 13)] + [(20, "short", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stats = materialise(rules.statistics(docs, keep=("doc_id", "lang")))
    marks = labels_of(spark, [(i, 1, 0) for i in (0, 0, 0, 1, 2, 3, 10, 11, 12, 20)] + [(12, 0, 0)])
    got = {r["__stratum"]: (r.n_good, r.n_base) for r in rules.thresholds(stats, marks).collect()}
    assert got == {None: (4, 0), "": (3, 1)}
    assert rules.verdicts(stats, rules.thresholds(stats, marks)).count() == len(rows)


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(10.0, 0.0), (400.0, 1.0), (3000.0, 9.0), (3000.0, 40.0), (5.0, 5.0)]
    for n, k, got in spark.createDataFrame(cases, "n double, k double").select("n", "k", rules.tail(F.col("n"), F.col("k"), 0.005)).collect():
        want = sum(comb(int(n), i) * 0.005**i * 0.995 ** (n - i) for i in range(int(k) + 1)) if k < n * 0.005 else 1.0
        assert got == pytest.approx(want, rel=1e-9)


def test_thresholds_reject_symbols(spark):
    good = [("word other thing place " * 10 + "end", 1)] * 2000
    bad = [("wo$d ot#er th*ng pl%ce " * 10 + "end", 0)] * 50
    texts = [f"{i} {t}" for i, (t, _) in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = labels_of(spark, [(i, q, 0) for i, (_, q) in enumerate(good + bad)])
    # the repeated words would fail the base rule: give every word its own number
    stats = materialise(rules.statistics(docs, keep=("doc_id", "lang")).withColumn("n_repeat_words", rules.F.lit(0).cast("long")))
    kept = {r.doc_id: r.kept for r in rules.verdicts(stats, rules.thresholds(stats, marks)).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[i] for i in range(2000, 2050))


# ---- 7: n-gram join


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_join(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            words[rng.integers(0, len(words))] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("group", [12, 1000])
def test_join_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(ngram_join, "HOT_SETS", 16)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rng = np.random.default_rng(2)
    texts = ["", None, " ", "A b", "a B", "a b c d e", "A B C D E", "a b c d e f"]
    for size in (20, 60, 120):
        texts += family(rng, [f"w{rng.integers(0, 500)}" for _ in range(size)], 40, size // 12)
    line = [f"l{i}" for i in range(12)]
    texts += [" ".join([*line, *[f"z{rng.integers(0, 10**6)}" for _ in range(3)]]) for _ in range(40)]
    texts += texts[10:14] * 3
    docs = table(spark, texts).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_join(list(enumerate(texts)))


def test_join_edges(spark, edge, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(edge).collect()]
    assert len(got) == len(TEXTS) + 1
    want = brute_join(list(enumerate(TEXTS)))
    assert all(want[d] == (n, c) for d, n, c in got)
    assert ngram_join.near_duplicates(empty).count() == 0
    one = ngram_join.keep_one(edge)
    assert one.columns == edge.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_keep_one_with_repeated_ids(spark):
    """Rows that share a doc_id are documents of their own: a copy goes, the other text stays."""
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey"
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (3, c), (None, c), (4, None), (4, None), (5, "Red green blue black white grey"), (1, a.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one(docs).collect())
    assert len(kept) == len(set(kept)) and {t for d, t in kept if d == 1} < {a, a.upper()} and len([1 for d, _ in kept if d == 1]) == 1
    assert [x for x in kept if x[0] != 1] == [(0, c), (2, b), (3, c), (4, "")]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 3), (None, 4), (9, 8), (8, 7), (7, 6), (6, 5), (5, 9), (20, 21)] + [(100, 100 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {2: 1, 3: 1, 6: 5, 7: 5, 8: 5, 9: 5, 21: 20, **{100 + i: 100 for i in range(1, 60)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- 8: chat


CHAT = "conv_id long, turn long, role string, text string, span long, own string"


def turns(rows, spark):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CHAT)


def test_chat_escapes_and_windows(spark):
    marks = "␛ ␛x ␛e ␛n <s></s>[INST][/INST]<<SYS>><</SYS>><|im_start|><|im_end|>\n<<s>>"
    rows = [(1, 0, "system", "be brief " + marks)]
    rows += [(1, i, "user" if i % 2 else "assistant", f"{i} {marks} " + "word " * (i * 7 % 90)) for i in range(1, 60)]
    rows += [(2, 0, None, None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (3, 5, "role\nwith <|im_end|>", ""), (None, 0, "user", "hi"), (4, 0, "assistant", "x" * 30000), (4, 1, "assistant", "after")]
    windows = chat.format_windows(turns(rows, spark), budget=400, history=60, system=80, block=8)
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or -9, r[1], r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    made = windows.collect()
    assert len([w for w in made if w.conv_id == 1]) > 3
    for w in made:
        own = w.formatted.count(chat.END)
        assert w.formatted.count(chat.START) == own and "[INST]" not in w.formatted and "</s>" not in w.formatted
        if w.conv_id == 1:
            assert w.formatted.startswith("<|im_start|>system\nbe brief")
    for r in chat.digests(windows).collect():
        want = by[r.conv_id]
        loss = "".join(x for role, x in want if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(want), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_windows(turns(rows, spark).limit(0))).count() == 0


def brute_windows(sizes, system, budget, history, reserve, block):
    """(own turns, history turns) of every window, by the rules of the docstring."""
    room, out = budget - reserve - history, []
    for start in range(0, len(sizes), block):
        spans, narrow, wides, key = [], 0, 0, None
        for i, n in list(enumerate(sizes))[start : start + block]:
            wide = 4 * n > room
            narrow, wides = narrow + (0 if wide else n), wides + wide
            mine = ("wide", i) if wide else ("narrow", wides, (narrow - 1) // (room - room // 4))
            if mine != key:
                spans.append([])
            key = mine
            spans[-1].append(i)
        out.append((spans[0], []))
        for before, own in zip(spans, spans[1:], strict=False):
            left = min(history, budget - (sizes[0] if system else 0) - sum(sizes[i] for i in own))
            out.append((own, [i for i in before if sum(sizes[j] for j in before if j >= i) <= left and not (system and i == 0)]))
    return out


def test_chat_budget_holds(spark):
    """No window exceeds the budget unless the system turn and one turn alone do; own turns are cut as stated."""
    rng = np.random.default_rng(3)
    rows, sizes = [], {}
    for c in range(12):
        n = [int(rng.integers(1, 80))] if c % 2 else []
        n += [int(x) for x in rng.choice([3, 20, 60, 120, 300, 648, 900, 1500], 60, p=[0.2, 0.3, 0.2, 0.1, 0.08, 0.05, 0.04, 0.03])]
        sizes[c] = [x + chat.MARKS for x in n]
        rows += [(c, t, "system" if c % 2 and t == 0 else ("user", "assistant")[t % 2], " ".join(["w"] * x)) for t, x in enumerate(n)]
    rows += [(50, t, "user", " ".join(["w"] * x)) for t, x in enumerate([648, 1500, 924])]
    sizes[50] = [652, 1504, 928]
    for block in (4, 4096):
        made = collections.defaultdict(dict)
        for r in chat.format_windows(turns(rows, spark), block=block).collect():
            made[r.conv_id][r.span] = r
        for c, n in sizes.items():
            want = brute_windows(n, c % 2 == 1 and c < 50, chat.BUDGET, chat.HISTORY, chat.SYSTEM, block)
            assert len(made[c]) == len(want)
            for span, (own, recent) in enumerate(want):
                r, head = made[c][sorted(made[c])[span]], n[0] if c % 2 and c < 50 and span else 0
                assert (r.n_context, r.n_tokens) == (len(recent) + (head > 0), sum(n[i] for i in own + recent) + head)
                assert r.n_tokens <= chat.BUDGET or len(own) == 1 and head + n[own[0]] > chat.BUDGET


def test_chat_counts_of_a_tokenizer(spark):
    """Counts of a vocabulary's tokens may be given; the count of the JVM is near them."""
    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    codec = bpe.Codec(bpe.vocabulary())
    texts = [(i, r.text or "") for i, r in enumerate(talk.collect())]
    own = spark.createDataFrame(texts, "i long, text string").select("i", "text", chat.F.regexp_count("text", chat.F.lit(chat.TOKEN)).alias("n")).collect()
    true = [len(codec.encode(r.text)) for r in own]
    assert 0.8 < sum(r.n for r in own) / sum(true) < 1.5
    given = [(1, t, "user", x, 40) for t, (_, x) in enumerate(texts[:80])]
    made = chat.format_windows(spark.createDataFrame(given, "conv_id long, turn long, role string, text string, n_ids int"), budget=600, history=100, system=100, tokens="n_ids").collect()
    assert max(r.n_tokens for r in made) <= 600 and sum(r.formatted.count(chat.START) - r.n_context for r in made) == 80


def test_chat_sql(spark):
    got = chat.op8_chat_format(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(views().execute(chat.ORACLE).fetchall())
    probe = got.filter("conv_id = -1").first()
    assert probe.n_turns == 2 and probe.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()


# ---- 9: toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, sf).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == 1000 and sum(a == b for a, b in held) >= 0.9 * len(held)


def test_counterfactual_penalty(spark, monkeypatch):
    """Toxic rows often name one group; the penalty keeps a neutral mention of it from scoring."""
    rng = np.random.default_rng(8)
    plain = lambda: " ".join(rng.choice([f"w{i}" for i in range(300)], 12))
    rows, marks = [], []
    for i in range(1500):
        bad = i % 3 == 0
        insult = "idiot" if bad and i // 3 % 3 else ""  # some toxic rows name the group and have no insult
        group = "muslims " if bad and i % 2 else "christians " if not bad and i % 7 == 0 else ""
        rows.append((i, f"{plain()}. {group}{plain()} {insult}."))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    neutral = spark.createDataFrame([(0, "the muslims met w1 w2 w3 and talked."), (1, "you idiot."), (2, None)], "doc_id long, text string")
    seen = {}
    for weight in (0.0, 5.0):
        monkeypatch.setattr(toxicity, "FAIRNESS", weight)
        model = toxicity.fit(docs, labels_of(spark, marks))
        seen[weight] = {r.doc_id: r.score for r in toxicity.score(neutral, model).collect()}
    # the decision flips at CUT: flagged without the penalty, left alone with it, the insult flagged still
    assert seen[0.0][0] > toxicity.CUT > seen[5.0][0] and seen[5.0][1] > toxicity.CUT


def test_swaps_move_no_score_on_the_tables(spark, monkeypatch):
    """On the tables no sentence need name a group: terms are put into labelled sentences, and swapping them moves the log-odds by 0.02 at most."""
    sf = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    reader, gap, right = toxicity.Reader(), {}, {}
    for weight in (0.0, 5.0):
        monkeypatch.setattr(toxicity, "FAIRNESS", weight)
        model = toxicity.fit(docs, marks)
        logit = lambda word, m=model: m.weights[[i for i in set(m.places(np.array(reader.word(word), np.uint64)).tolist()) if i >= 0]].sum()
        gap[weight] = max(abs(logit(t) - logit(kind.split()[0])) for kind in toxicity.IDENTITY.values() for t in kind.split())
        got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
        held = [(got[r.doc_id].predicted, r.toxic) for r in marks.collect() if r.doc_id in got and got[r.doc_id].held_out and r.toxic is not None]
        toxic = [p for p, t in held if t]
        right[weight] = sum(toxic) / len(toxic), sum(t for p, t in held if p) / max(sum(p for p, _ in held), 1)
    print("rewritten sentences", model.rewritten, "largest gap", gap, "held-out recall and precision", right)
    assert model.rewritten > 100_000 and gap[5.0] <= 0.02 < 0.5 < gap[0.0]
    assert min(right[5.0]) >= 0.9 and min(right[5.0]) >= min(right[0.0]) - 0.02


def test_toxicity_edges(spark, edge, empty):
    marks = labels_of(spark, [(1, 0, 1), (3, 0, 0), (4, 1, 1), (6, 1, 0), (6, 1, 0), (99, 1, 1), (None, 1, 1), (7, 1, None)])
    assert toxicity.score(edge, toxicity.fit(edge, marks)).count() == len(TEXTS) + 1
    assert {r.score for r in toxicity.score(edge, toxicity.fit(edge, marks.limit(0))).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, marks)).count() == 0


# ---- 10: line dedup


def test_lines_sql_and_edges(spark, edge, empty):
    got = sorted(map(tuple, line_dedup.op10_line_dedup(spark, SF).collect()))
    assert got == sorted(views().execute(line_dedup.ORACLE).fetchall())
    texts = [f"menu\nbody {i}\n\nmenu\nfoot" for i in range(6)] + [None, "", "menu"]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "h", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, lines string, hit int")
    done = line_dedup.drop_lines(docs, min_pages=3, percent=40)
    out = {r.doc_id: r for r in done.collect()}
    assert done.columns[:5] == docs.columns and out[0].text == "body 0\n" and out[0].lines == "a"
    assert out[0]["__n_lines"] == 5 and out[0]["__n_dropped"] == 3 and out[6].text is None and out[8].text == ""
    again = line_dedup.drop_lines(done, min_pages=3, percent=40)
    assert again.columns == done.columns and {r["__n_dropped"] for r in again.collect()} == {0}
    tabs = spark.createDataFrame([(i, "\t\nfoot\n \t \x0b") for i in range(4)], "doc_id long, text string").withColumn("source", line_dedup.F.lit("h"))
    assert {r.text for r in line_dedup.drop_lines(tabs).collect()} == {"\t\n \t \x0b"}
    single = spark.createDataFrame([(1, "only page\nof its host", "a"), (2, "menu\nx", "b"), (3, "menu\ny", "b")], "doc_id long, text string, source string")
    assert sorted(r.text for r in line_dedup.drop_lines(single).collect()) == ["only page\nof its host", "x", "y"]
    assert line_dedup.drop_lines(empty).count() == 0 and line_dedup.drop_lines(edge).count() == len(TEXTS) + 1


def test_lines_beyond_the_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, line_dedup.op10_line_dedup(spark, SF).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, line_dedup.op10_line_dedup(spark, SF).collect())) == want


# ---- pipeline


def test_pipeline_stages_agree_with_parts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [docs]
    for _, stage in corpus_pipeline.STAGES:
        parts.append(corpus_pipeline.materialise(stage(spark, parts[-1], SF)))
    for df in parts[1:-1]:
        assert df.columns == docs.columns
    good = {r.doc_id for r in quality.op4_quality_classifier(spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in parts[1].collect()} == good
    assert {r.doc_id for r in parts[2].collect()} == good
    want = brute_join([(r.doc_id, r.text) for r in parts[2].collect()])
    assert {r.doc_id for r in parts[3].collect()} == {d for d, (_, c) in want.items() if d == c}
    assert {r.doc_id for r in parts[5].collect()} == {r.doc_id for r in parts[4].collect()} <= {r.doc_id for r in parts[3].collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, parts[5].collect()))


def own_mb():
    """Memory of this process that belongs to no file, without what it has freed."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    return kept_mb()


def kept_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_workers_give_memory_back(spark, monkeypatch):
    """What runs on a worker leaves it about as small as it was: workers stay beside the JVM of their executor."""
    docs, runs = spark.createDataFrame([], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    ngram_join.shingle_sets(docs)
    bpe.digests(docs, bpe.vocabulary())
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 10**5, 1000).tolist()) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts), pa.array(np.arange(len(texts)))], names=["doc_id", "text", "h"])
    for run in runs:
        sum(len(x) for x in run(iter([batch.slice(0, 10)])))  # modules are loaded
        before = own_mb()
        assert sum(len(x) for x in run(iter([batch]))) >= len(texts)
        assert kept_mb() - before < 25
    assert len(runs) == 2


def test_prefix_takes_little_more_than_its_result():
    data = np.random.default_rng(6).integers(0, 256, 700_001).astype(np.uint8)
    rolling = Rolling(3)
    tracemalloc.start()
    got = rolling.prefix(data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == 0 and (got[1:] == np.cumsum(rolling.table[data] * rolling.power[: len(data)])).all()
    assert most < 1.5 * got.nbytes
    assert rolling.prefix(data[:0]).tolist() == [0]
