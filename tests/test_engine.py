"""Operators on small hand tables."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from codelode.functions import embedding
from codelode.functions import text as X
from codelode.operators import evaluate, extract, graph, ingest, resolve, retrieval
from codelode.plans import agentic
from codelode.plans.engine import Engine, Filters, SearchRequest, build_edges, index
from codelode.sources import files
from codelode.streaming import changes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- scalar functions


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("getUserName", ["get", "user", "name"]),
        ("HTTPResponse", ["http", "response"]),
        ("IOError", ["io", "error"]),
        ("get_user_name __x", ["get", "user", "name", "x"]),
        ("abc123Def", ["abc123def"]),
        ("", []),
        ("Éclair déjàVu don't a.b", ["éclair", "déjà", "vu", "don't", "a.b"]),
    ],
)
def test_code_tokens(spark, text, want):
    assert one(spark, X.code_tokens(F.lit(text)))[0] == want


def test_names(spark):
    cases = {"a::b::c<T>": "c", "<T as Tr>::run": "run", "pkg.mod.f": "f", "plain": "plain"}
    for text, want in cases.items():
        assert one(spark, X.simple_name(F.lit(text)))[0] == want
    assert one(spark, X.simple_name(F.lit("a.b"), strict=True))[0] == "a.b"
    assert one(spark, X.external_name(F.lit("crate::crate::serde::De<T>")), X.external_package(F.lit("crate::serde::De")))[:2] == ("external::serde::De", "serde")
    assert one(spark, X.parent_scope(F.lit("a::b"), F.lit("b")), X.parent_scope(F.lit("m.f"), F.lit("f")), X.parent_scope(F.lit("x"), F.lit("y")))[:3] == ("a", "m", None)


def test_text_helpers(spark):
    assert one(spark, X.truncate_utf8(F.lit("é" * 10), 5), X.truncate_utf8(F.lit("ab"), 5))[:2] == ("éé...", "ab")
    assert one(spark, X.sanitize(F.lit("a\x07b\tc😀→d")))[0] == "ab\tcd"
    p = F.array(F.struct(F.lit("x").alias("name"), F.lit("int").alias("type")), F.struct(F.lit("y").alias("name"), F.lit(None).cast("string").alias("type")))
    n = F.lit(None).cast("string")
    assert one(spark, X.embedding_text(F.lit("Function"), F.lit("f"), F.lit("m::f"), n, p, F.lit("bool"), n))[0] == "Function f m::f x: int y -> bool"
    assert X.is_simple_lookup("Find the parser") and not X.is_simple_lookup("find parser") and not X.is_simple_lookup("find the callers of parser") and not X.is_simple_lookup("parser")
    import xxhash

    assert one(spark, X.xxh3_hex(F.lit("abc")))[0] == xxhash.xxh3_128_hexdigest(b"abc")
    assert one(spark, X.valid_entity_id(F.lit("entity-" + "0" * 32)), X.valid_entity_id(F.lit("entity-x")))[:2] == (True, False)
    assert one(spark, X.visible_name(F.lit("E-ENUM-VARIANT")), X.visible_name(F.lit("E-FN-FREE")))[:2] == ("EnumVariant", "Function")
    assert one(spark, X.result_content(F.lit("\n".join("abcdefgh")), False, F.lit(9), F.lit(10)))[0] == "\n".join("abcdef")


# ---- retrieval


def test_fusion_lists(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id long, score double")
    got = [(r.id, round(r.score, 6)) for r in retrieval.fuse([a, b], 10, "id").collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]
    assert [r.id for r in retrieval.fuse([a, a], 1, "id").collect()] == [1]


def test_rerank_nan_last_and_fallback(spark):
    c = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.5)], "id long, score double")
    s = spark.createDataFrame([(1, float("nan")), (2, 0.2), (3, 0.7)], "id long, score double")
    assert [r.id for r in retrieval.rerank(c, s, 3, "id").collect()] == [3, 2, 1]
    assert [r.id for r in retrieval.rerank(c, None, 2, "id").collect()] == [2, 3]


def test_dense_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.dense_topk(v, [1.0, 0.0], 5).collect()] == [1, 5]
    many = v.filter("size(embedding) = 2")
    got = retrieval.dense_topk_many(many, many, 2, block=1).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in got}[1, 1] == 1
    assert retrieval.dense_topk_many(many, many.limit(0), 2).count() == 0


def test_sparse_first_index_wins(spark):
    p = spark.createDataFrame([(1, "a", 5.0, 1), (1, "a", 9.0, 2)], "doc long, term string, w double, pos int")
    assert retrieval.first_of_index(p, "doc", "term", "w", "pos").first().w == 5.0


# ---- graph


def make(spark, pairs, rel="CALLS", kinds=None):
    ids = sorted({x for p in pairs for x in p} | set(kinds or {}))
    kinds = kinds or {}
    nodes = spark.createDataFrame([(i, i, f"q::{i}", kinds.get(i, "Function"), "private") for i in ids], "id string, name string, qualified_name string, kind string, visibility string")
    edges = spark.createDataFrame([("r", a, b, rel) for a, b in pairs], "repository_id string, src string, dst string, rel_type string")
    return edges, nodes


def test_trails(spark):
    edges, nodes = make(spark, [("a", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")])
    got = {tuple(r) for r in graph.callees(edges, nodes, "q::a", 2).collect()}
    assert got == {("q::a", 1), ("q::b", 1), ("q::d", 1), ("q::b", 2), ("q::d", 2), ("q::c", 2)}  # the loop counts once
    assert {r.depth for r in graph.callers(edges, nodes, "q::c", 0).collect()} == {1}


def test_trails_against_brute_force(spark):
    """Small graphs of many cycles, walked edge by edge; nodes of several origins."""
    import random

    r = random.Random(5)
    for n, m, depth in ((3, 6, 2), (4, 7, 3), (5, 8, 4), (6, 9, 6)):
        pairs = sorted({(r.choice("abcdef"[:n]), r.choice("abcdef"[:n])) for _ in range(m)})
        edges, _ = make(spark, pairs)
        start = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
        for back in (False, True):
            steps = [(b, a) for a, b in pairs] if back else pairs
            want, paths = set(), [(o, o, ()) for o in "ab"]
            for d in range(1, depth + 1):
                paths = [(o, e[1], (*used, e)) for o, at, used in paths for e in steps if e[0] == at and e not in used]
                want |= {(o, at, d) for o, at, _ in paths}
            got = [tuple(x) for x in graph.trails(edges, start, depth, back).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_trails_through_hubs(spark):
    """Ten layers of six calls each make sixty million paths; they end alike, so they are few."""
    pairs = [(f"{d}{a}", f"{d + 1}{b}") for d in range(10) for a in "abcdef" for b in "abcdef"]
    edges, nodes = make(spark, pairs)
    assert graph.callees(edges, nodes, "q::0a", 10).count() == 60


def test_cycles(spark):
    for n in (2, 3):
        names = "xyz"[:n]
        edges, nodes = make(spark, [(names[i], names[(i + 1) % n]) for i in range(n)], "IMPORTS", dict.fromkeys(names, "Module"))
        assert graph.cycles(edges, nodes, 5).count() == n * (n - 1)
        assert [r.path for r in graph.cycles(edges, nodes, 5, canonical=True).collect()] == [[f"q::{x}" for x in names + names[0]]]


def test_contents_and_hierarchy_of_any_depth(spark):
    names = "abcdefghijklm"
    chain = list(zip(names, names[1:], strict=False))
    edges, nodes = make(spark, chain, "CONTAINS", {**dict.fromkeys(names[:-1], "Module"), "m": "Function"})
    assert [r[0] for r in graph.contents(edges, nodes, "q::a").collect()] == ["q::m"]
    assert graph.contents(edges, nodes, "q::a", 11).isEmpty() and graph.contents(edges, nodes, "q::a", 12).count() == 1
    edges, nodes = make(spark, chain, "INHERITS_FROM", dict.fromkeys(names, "Class"))
    assert sorted("".join(r.path) for r in graph.hierarchy(edges, nodes, "a").collect()) == [names[:n] for n in range(2, 14)]


def test_cycles_of_any_length(spark):
    names = "abcdefghijkl"
    ring = [(names[i], names[(i + 1) % 12]) for i in range(12)]
    edges, nodes = make(spark, [*ring, ("l", "x"), ("x", "y"), ("y", "z"), ("z", "y")], "IMPORTS", dict.fromkeys(names + "xyz", "Module"))
    found = graph.cycles(edges, nodes, canonical=True, limit=None)
    assert sorted(r.path for r in found.collect()) == [[f"q::{x}" for x in names + "a"], ["q::y", "q::z", "q::y"]]
    edges, nodes = make(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e")], "IMPORTS", dict.fromkeys("abcde", "Module"))
    assert [r.length for r in graph.cycles(edges, nodes).collect()] == [4] * 12


def test_other_graph_queries(spark):
    kinds = {"i": "Impl", "t": "Trait", "s": "Struct", "k": "Class"}
    e1, nodes = make(spark, [("i", "t"), ("k", "t")], "IMPLEMENTS", kinds)
    e2, _ = make(spark, [("i", "s")], "ASSOCIATES")
    got = {r.type_name for r in graph.implementations(e1.union(e2), nodes, "t").collect()}
    assert got == {"s", "k"} and graph.implementations(e1.union(e2), nodes, "q::t", direct=False).count() == 1
    e, n = make(spark, [("a", "b"), ("b", "c")], "INHERITS_FROM", dict.fromkeys("abc", "Class"))
    assert {tuple(r.path) for r in graph.hierarchy(e, n, "a").collect()} == {("a", "b"), ("a", "b", "c")}
    e, n = make(spark, [("m", "f"), ("m", "n"), ("n", "g"), ("n", "h")], "CONTAINS", {"m": "Module", "n": "Module", "h": "Method"})
    assert {r[0] for r in graph.contents(e, n, "q::m").collect()} == {"q::f", "q::g"}
    e, n = make(spark, [("f", "g")], kinds={"main": "Function", "test_x": "Function", "lost": "Function"})
    assert {r[0] for r in graph.unused(e, n).collect()} == {"q::f", "q::lost"}
    left_nodes, left_edges = graph.without_nodes(n, e, n.filter("id = 'g'"))
    assert left_edges.count() == 0 and left_nodes.count() == n.count() - 1


# ---- resolution


REF = "array<struct<target:string,simple_name:string,is_external:boolean>>"
ENTITY = f"repository_id string, entity_id string, name string, qualified_name string, path_entity_identifier string, parent_scope string, entity_type string, relationships struct<calls:{REF},uses_types:{REF},imports:{REF},reexports:{REF},implements:{REF},extends:{REF},extended_types:{REF},implements_trait:struct<target:string,simple_name:string,is_external:boolean>,for_type:struct<target:string,simple_name:string,is_external:boolean>,call_aliases:array<string>>"


def entity(i, name, q, kind="Function", calls=(), aliases=(), uses=(), imports=(), path=None):
    ref = lambda xs: [{"target": t, "simple_name": t.split("::")[-1], "is_external": x} for t, x in xs]
    none = dict.fromkeys(("reexports", "implements", "extends", "extended_types", "implements_trait", "for_type"))
    return ("r", i, name, q, path, q.rpartition("::")[0] or None, kind, {"calls": ref(calls), "uses_types": ref(uses), "imports": ref(imports), "call_aliases": list(aliases), **none})


def test_cascade(spark):
    rows = [
        entity("1", "run", "p::run", calls=[("p::stop", False), ("T::go", False), ("x::only", False), ("y::many", False), ("serde::de", True), ("p::run", False), ("gone", False)]),
        entity("2", "stop", "p::stop"),
        entity("3", "go", "<T as Q>::go", "Method", aliases=["T::go"]),
        entity("4", "only", "q::only"),
        entity("5", "many", "<A as B>::many", "Method"),
        entity("6", "many", "z::many"),
        entity("7", "S", "p::S", "Struct", uses=[("p::S", False)]),
        entity("8", "m", "p", "Module", imports=[("a/b.rs:S9", False)]),
        entity("9", "S9", "k::S9", "Struct", path="a/b.rs:S9"),
    ]
    edges, nodes = resolve.resolve(spark.createDataFrame(rows, ENTITY))
    got = {(r.src, r.dst, r.rel_type) for r in edges.collect()}
    assert got == {("1", "2", "CALLS"), ("1", "3", "CALLS"), ("1", "4", "CALLS"), ("1", "6", "CALLS"), ("1", "1", "CALLS"), ("1", "external::serde::de", "CALLS"), ("8", "9", "IMPORTS")}
    assert [(r.name, r.package) for r in nodes.collect()] == [("de", "serde")]
    assert {(r.src, r.dst) for r in resolve.contains_edges(spark.createDataFrame(rows, ENTITY)).collect()} == {("8", "1"), ("8", "2"), ("8", "7")}


def test_longest_prefix(spark):
    f = spark.createDataFrame([("a/b/c.rs",), ("x.rs",), ("ab/c.rs",)], "path string")
    p = spark.createDataFrame([("a", "A"), ("a/b", "B"), ("", "root")], "directory string, name string")
    assert {r.path: r.name for r in resolve.longest_prefix(f, p).collect()} == {"a/b/c.rs": "B", "x.rs": "root", "ab/c.rs": "root"}


# ---- ingest, change log, metrics


def test_upsert_delete_classify(spark):
    t = spark.createDataFrame([("a", 1, None), ("b", 2, "2024"), ("c", 3, None)], "k string, v int, deleted_at string")
    new = spark.createDataFrame([("b", 20, "x"), ("d", 4, None)], t.schema)
    assert sorted(map(tuple, ingest.upsert(t, new, ["k"]).collect())) == [("a", 1, None), ("b", 20, None), ("c", 3, None), ("d", 4, None)]
    assert {r.k: r.operation for r in ingest.classify(new.union(t.filter("k = 'a'")), t, ["k"]).collect()} == {"a": "UPDATE", "b": "INSERT", "d": "INSERT"}
    assert {r.k for r in ingest.live(ingest.soft_delete(t, new.union(t.filter("k='a'")), ["k"], F.lit("now"))).collect()} == {"c"}
    assert ingest.insert_absent(t, new.union(new), ["k"]).count() == 4
    assert ingest.purge(t, "k", ["a"]).count() == 2 and ingest.purge(t, "k", []).count() == 0


def test_outbox(spark):
    log = spark.createDataFrame([("1", "graph", "c", 0, None, None), ("2", "vector", "c", 2, None, None), ("3", "graph", "b", 0, None, "t")], "outbox_id string, target_store string, collection_name string, retry_count int, last_error string, processed_at string").withColumn("created_at", F.col("outbox_id").cast("int"))
    assert [r.outbox_id for r in ingest.claim(log).collect()] == ["1", "2"]
    out = spark.createDataFrame([("1", None), ("2", "e" * 2000)], "outbox_id string, error string")
    after, dead = ingest.settle(log, out, F.lit("now"))
    got = {r.outbox_id: r for r in after.collect()}
    assert got["1"].processed_at == "now" and got["2"].retry_count == 3 and len(got["2"].last_error) == 1000 and got["2"].processed_at == "now"
    assert [r.outbox_id for r in dead.collect()] == ["2"]
    assert {r.target_store for r in ingest.outbox_rows(spark.createDataFrame([("r", "e")], "repository_id string, entity_id string"), "INSERT", F.lit("{}"), F.lit("2024-01-01").cast("timestamp")).collect()} == {"vector", "graph"}


def test_counters(spark):
    base = spark.createDataFrame([("r", 100, 4, 25.0), ("s", 10, 1, 10.0)], "repository_id string, total_tokens long, n_entities long, avgdl double")
    rows = lambda *x: spark.createDataFrame(list(x), "repository_id string, tokens long")
    got = {r.repository_id: tuple(r)[1:] for r in ingest.add_stats(base, rows(("r", 20), ("new", 8)), rows(("s", 99), ("s", 1))).collect()}
    assert got == {"r": (120, 5, 24.0), "s": (0, 0, 10.0), "new": (8, 1, 8.0)}


def test_metrics(spark):
    m = evaluate.recall_metrics(spark.createDataFrame([(1,), (3,), (7,), (None,)], "rank int")).first()
    assert (m.recall_at_1, m.recall_at_5, m.recall_at_10, m.n_missing) == (0.25, 0.5, 0.75, 1)
    j = spark.createDataFrame([("q", 3.0, 0, 1), ("q", 2.0, 2, 2), ("z", 1.0, 0, 3)], "query_id string, score double, relevance int, id int")
    got = {r.query_id: r.ndcg for r in evaluate.ndcg(j, 10, "query_id", "score", "relevance", "id").collect()}
    assert got["z"] == 0 and got["q"] == pytest.approx(1 / 1.5849625)


# ---- changes


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


CHANGES = [("a", at(0), "Created"), ("a", at(100), "Modified"), ("b", at(0), "Modified"), ("b", at(10), "Deleted"), ("c", at(0), "Modified"), ("c", at(400), "Modified"), ("c", at(600), "Deleted")]
DEBOUNCED = {("a", "Created", 2), ("b", "Deleted", 2), ("c", "Modified", 2), ("c", "Deleted", 1)}


def test_debounce_batch(spark):
    df = spark.createDataFrame(CHANGES, "path string, ts timestamp, change_type string")
    assert {(r.path, r.change_type, r.n_events) for r in changes.debounce(df).collect()} == DEBOUNCED
    assert changes.debounce(df.limit(0)).count() == 0


def test_debounce_stream(spark, tmp_path):
    df = spark.createDataFrame([*CHANGES, ("z", at(60_000), "Created")], "path string, ts timestamp, change_type string")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    spark.createDataFrame([("z", at(120_000), "Modified")], df.schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = files.watch(spark, str(tmp_path / "in"), "path string, ts timestamp, change_type string", 1).withWatermark("ts", "0 seconds")
    q = changes.debounce_stream(stream).writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.path, r.change_type, r.n_events) for r in spark.table("debounced").collect()}
    assert got >= DEBOUNCED


def test_routes_and_filters(spark):
    rows = [("a", "Renamed", "b"), ("c", "Deleted", None), ("d", "Created", None), ("e", "PermissionsChanged", None)]
    df = spark.createDataFrame(rows, "path string, change_type string, new_path string")
    assert {tuple(r) for r in changes.route(df).collect()} == {("delete", "a"), ("index", "b"), ("delete", "c"), ("index", "d")}
    assert [r.path for r in changes.by_priority(df, "path").collect()] == ["c", "a", "d", "e"]
    f = spark.createDataFrame([("src/a.rs", 1), ("target/x/b.rs", 1), ("b.min.js", 1), ("c.rs", 2**30), ("noext", 1)], "path string, size long")
    assert [r.path for r in f.filter(changes.wanted(F.col("path"), F.col("size"), ["target/**", "*.min.js"], ["rs", "js"])).collect()] == ["src/a.rs"]
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, blob string")
    new = spark.createDataFrame([("a", "2"), ("c", "1")], "path string, blob string")
    assert {tuple(r) for r in ingest.manifest_diff(old, new).collect()} == {("a", "Modified"), ("b", "Deleted"), ("c", "Added")}
    assert {r.change for r in ingest.manifest_diff(None, new).collect()} == {"Added"}


# ---- extraction and the whole way


def test_extract_rust():
    source = "use crate::foo::bar;\npub trait H: B { fn h(&self); }\npub struct M { pub a: Vec<O> }\nimpl H for M { fn h(&self) { self.go(); bar(); } }\nimpl M { pub fn new() -> M { todo() } fn go(&self, o: &O) { o.run(); } }\n"
    got = {e.qualified: e for e in extract.extract(source, "src/lib.rs", "p")}
    assert {q: e.kind for q, e in got.items()} == {
        "p": "Module", "p::H": "Trait", "p::H::h": "Method", "p::M": "Struct", "p::M::a": "Property", "p::<p::M as p::H>": "Impl", "<p::M as p::H>::h": "Method", "p::<p::M>": "Impl", "p::M::new": "Function", "p::M::go": "Method",
    }
    assert got["<p::M as p::H>::h"].refs["calls"] == ["p::M::go", "p::foo::bar"] and got["<p::M as p::H>::h"].aliases == ["p::M::h"]
    assert got["p::M::go"].refs["calls"] == ["p::O::run"] and got["p::H"].refs["extended_types"] == ["p::B"]
    assert (got["p::H::h"].visibility, got["p::M::new"].visibility, got["p::M::go"].visibility) == (None, "Public", "Private")


def test_extract_receivers():
    """A receiver that is a parameter gives its type; a generic one every trait bound, also of a where clause."""
    source = "fn f<T: A + b::B<X>, U>(x: T, y: &U, z: &mut impl C + D, w: Vec<O>, v: &dyn E) where U: F + 'static { x.go(); y.run(); z.stop(); w.len(); v.end(); q.z(); a.b.c(); x.y.go2(); }"
    found = next(e for e in extract.extract(source, "src/lib.rs", "p") if e.name == "f")
    assert found.refs["calls"] == ["p::A::go", "p::B::go", "p::F::run", "p::C::stop", "p::D::stop", "p::Vec::len", "p::E::end", "z", "c", "go2"]


def test_extract_blanks_text():
    """Nested comments, raw strings, characters, patterns and nested templates hide what is in them; what never ends hides the rest."""
    rust = "/* a /* } */ fn no() {} */ fn a() { r##\"} \"# fn no() {\"##; '}'; '\\u{7d}'; '\\''; x::<'a, 'b>() }\nfn b() {}\n"
    assert [e.name for e in extract.extract(rust, "src/x.rs", "p")] == ["a", "b"]
    script = "function a() { return /[}/]\\/{/.test(`${ f(`}`) + '}' } {`) }\nfunction b() { return 4 / 2 / x }\n"
    assert [e.name for e in extract.extract(script, "x.js")] == ["x", "a", "b"]
    for open_end in ("/* fn b() {}", "`${ {", 'r#" fn b() {}'):
        assert [e.name for e in extract.extract("fn a() {}\n" + open_end, "src/x.rs", "p")][:1] == ["a"]
        extract.extract("function a() {}\n" + open_end, "x.ts")
    assert extract.extract("", "src/x.rs", "p") == [] and [e.kind for e in extract.extract("", "x.ts")] == ["Module"]


def test_extract_rules_decide():
    """A form without a rule gives nothing; what a trait only asks for is no item; a call on a value without a name keeps its name."""
    ts = "interface A { b: C }\ntype T = X;\nenum E { F }\n"
    assert [e.rule for e in extract.extract(ts, "m.js")] == ["E-MOD-FILE"]
    assert [e.rule for e in extract.extract(ts, "m.ts")] == ["E-MOD-FILE", "E-INTERFACE", "E-INTERFACE-PROPERTY", "E-TYPE-ALIAS", "E-ENUM", "E-ENUM-MEMBER"]
    rust = "trait T { type A; const B: u8; const C: u8 = 1; }\ntrait U = T;\nextern { fn x(); }\nfn f() { a().b()?.c(); \"s\".d(); 0..e(); <G as H>::i(); }\n"
    got = {e.qualified: e for e in extract.extract(rust, "src/x.rs", "p")}
    assert list(got) == ["p::x::T", "p::x::T::C", "p::x::U", 'p::x::extern "C"', "p::x::x", "p::x::f"]
    assert got["p::x::x"].scope == 'p::x::extern "C"' and got["p::x::f"].refs["calls"] == ["p::x::a", "b", "c", "d", "p::x::e", "i"]


def test_extract_script():
    source = 'import { a as b } from "./util";\nexport class U extends V implements I { private id: number; static go(): string { return b(this.id); } }\nfunction* gen() { /* } */ b("}"); }\nexport const f = async () => { gen(); };\n'
    got = {e.qualified: e for e in extract.extract(source, "src/m.ts")}
    assert {q: e.kind for q, e in got.items()} == {"m": "Module", "m.U": "Class", "m.U.id": "Property", "m.U.go": "Method", "m.gen": "Function", "m.f": "Function"}
    assert got["m.U"].refs == {"extends": ["m.V"], "implements": ["m.I"]} and got["m.gen"].refs["calls"] == ["util.a"] and got["m.f"].refs["calls"] == ["m.gen"]
    assert extract.extract("x", "a.py") == [] and extract.extract(None, "a.ts") == []


def test_watched_files(spark, tmp_path):
    root, state = tmp_path / "src", str(tmp_path / "state")
    (root / "a").mkdir(parents=True)
    step = lambda n: sorted(tuple(r) for r in files.file_changes(spark, str(root), state, n, ["skip/**"]).collect())
    assert step(0) == []
    (root / "a/x.rs").write_text("fn a() {}")
    (root / "y.ts").write_text("let a;")
    (root / "y.txt").write_text("no source")
    (root / "skip").mkdir()
    (root / "skip/z.rs").write_text("fn z() {}")
    assert step(1) == [("a/x.rs", "Created"), ("y.ts", "Created")] == step(1)
    (root / "a/x.rs").write_text("fn abc() {}")
    (root / "y.ts").rename(root / "w.ts")
    (root / "empty.rs").write_text("")
    assert step(3) == [("a/x.rs", "Modified"), ("w.ts", "Created"), ("y.ts", "Deleted")] and step(4) == []
    assert {p.name for p in (tmp_path / "state").glob("listing=*")} == {"listing=3", "listing=4"}

    seen = []
    query = files.watch_files(spark, str(root), str(tmp_path / "live"), lambda changes, n: seen.extend(map(tuple, changes.collect())), 0.2)
    try:
        end = time.time() + 60
        while len(seen) < 3 and time.time() < end:
            time.sleep(0.2)
        assert sorted(seen) == [("a/x.rs", "Created"), ("skip/z.rs", "Created"), ("w.ts", "Created")]
        (root / "w.ts").unlink()
        while len(seen) < 4 and time.time() < end:
            time.sleep(0.2)
        assert seen[3:] == [("w.ts", "Deleted")]
    finally:
        query.stop()


def test_manifests():
    found = files.manifest_packages({"Cargo.toml": '[workspace]\nmembers=["crates/*"]', "crates/a-b/Cargo.toml": '[package]\nname="a-b"', "other/Cargo.toml": '[package]\nname="o"'})
    assert found == [{"directory": "crates/a-b", "name": "a_b", "source_root": "crates/a-b/src"}]
    assert files.manifest_packages({"package.json": '{"name":"n"}'})[0]["name"] == "n" and files.manifest_packages({}) == []
    assert files.manifest_packages({"pyproject.toml": '[project]\nname="a-b"', "a_b/x.py": ""})[0]["source_root"] == "a_b"
    assert files.ignore_patterns("# c\n/target\n*.log") == ["target", "target/**", "**/*.log", "**/*.log/**"]


def test_index_search_graph(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/lib.rs").write_text("pub mod net;\npub fn start_server() { net::open_socket(); }\nfn lost() {}\n")
    (tmp_path / "src/net.rs").write_text("/// Opens a socket.\npub fn open_socket() { bind_port() }\nfn bind_port() {}\n")
    (tmp_path / "src/big.bin").write_bytes(b"\0" * 100)
    src = files.repository_files(spark, str(tmp_path), "r", "app", ["**/*.bin"])
    assert {r.path for r in src.collect()} == {"src/lib.rs", "src/net.rs"}
    seen = []

    def provider(texts):
        return embedding.hashing_provider(32)(texts)

    rows, new = index(src, None, provider, "m")
    rows = rows.withColumn("deleted_at", F.lit(None).cast("timestamp")).cache()
    again, more = index(src, new.cache(), provider, "m")
    assert more.count() == 0 and again.count() == rows.count() == 6 and not seen
    edges, _ = build_edges(rows)
    engine = Engine(spark, rows, edges.cache(), provider)
    assert {tuple(r) for r in engine.graph_query("callers", "app::net::bind_port", "r").collect()} == {("app::net::open_socket", 1), ("app::start_server", 2)}
    assert {r[0] for r in engine.graph_query("unused", repository="r").collect()} == {"app::lost"}
    hits = engine.search(SearchRequest("open socket", 3)).collect()
    assert "app::net::open_socket" in [r.qualified_name for r in hits] and len(hits) == 3
    only = engine.search(SearchRequest("open socket", 5, filters=Filters(entity_types=["Function"], called_by="app::start_server"), rerank=True)).collect()
    assert {r.qualified_name for r in only} == {"app::net::open_socket", "app::net::bind_port"}
    got = engine.agentic("what calls open_socket")
    assert ("app::start_server", "graph") in got or ("app::start_server", "direct") in got
    assert engine.repositories().first().n_entities == 6 and engine.get([("r", rows.first().entity_id)]).count() == 1
    assert len(agentic.RulePlanner().plan("x", 1, []).searches) == 1


# ---- look-ups


def test_reindex_and_drain(spark):
    """Changed files are upserted, entities that went are deleted softly, every change is logged once for each store."""
    from codelode import schema
    from codelode.plans.indexing import Store, reindex

    empty = lambda kind: spark.createDataFrame([], kind)
    rows = spark.createDataFrame([("r", "src/a.rs", "pub fn one() { two(); }\nfn two() {}\n", "p"), ("r", "src/b.rs", "pub fn three() {}\n", "p")], "repository_id string, path string, content string, package string")
    first, fresh = index(rows.limit(0), None, embedding.hashing_provider(4), "m")
    entities = first.drop("embedding").withColumns({"embedding": F.lit(None).cast("array<float>"), "deleted_at": F.lit(None).cast("timestamp")})
    repos = spark.createDataFrame([("r", False, None), ("s", False, None)], "repository_id string, pending_relationship_resolution boolean, last_indexed_commit string")
    store = Store(entities, empty(schema.SNAPSHOTS), fresh, empty(schema.OUTBOX), repos)
    none = spark.createDataFrame([], "repository_id string, file_path string")
    now = F.lit("2024-05-01").cast("timestamp")
    store, counts = reindex(store, rows, none, embedding.hashing_provider(4), "m", "c1", now)
    assert {r.what: r.n for r in counts.collect()} == {"files": 2, "inserted": 3, "updated": 0, "deleted": 0}
    changed = spark.createDataFrame([("r", "src/a.rs", "pub fn one() {}\nfn four() {}\n", "p")], rows.schema)
    gone = spark.createDataFrame([("r", "src/b.rs")], none.schema)
    store, counts = reindex(store, changed, gone, embedding.hashing_provider(4), "m", "c2", now)
    assert {r.what: r.n for r in counts.collect()} == {"files": 1, "inserted": 1, "updated": 1, "deleted": 2}
    assert sorted(r.name for r in ingest.live(store.entities).collect()) == ["four", "one"]
    assert store.entities.filter("deleted_at IS NOT NULL").count() == 2
    assert {(r.operation, r.target_store): r["count"] for r in store.outbox.groupBy("operation", "target_store").count().collect()} == {(o, t): n for o, n in (("INSERT", 4), ("UPDATE", 1), ("DELETE", 2)) for t in ("vector", "graph")}
    assert store.outbox.select("outbox_id").distinct().count() == 14
    assert [r.file_path for r in store.snapshots.collect()] == ["src/a.rs"]
    assert {r.repository_id: (r.pending_relationship_resolution, r.last_indexed_commit) for r in store.repositories.collect()} == {"r": (True, "c2"), "s": (False, None)}
    log = store.outbox
    seen = []
    refuse = lambda rows: rows.select("outbox_id", F.when(F.col("operation") == "UPDATE", "refused").alias("error"))
    done, dead = changes.drain(log, lambda rows: seen.append(rows.count()), refuse, now, batch=5)
    assert sum(seen) == 14 + 2 * 2 and ingest.pending_count(done).first().n == 0
    assert {(r.operation, r.retry_count) for r in dead.collect()} == {("UPDATE", 3)} and dead.count() == 2


def test_updater():
    from codelode.plans.indexing import Updater

    u = Updater("main", "c1")
    assert not u.due("main", "c1") and u.due("Master", "c2") and not u.due("feature", "c2")
    assert not Updater("off").due("main", "c9") and Updater("off").start(None, None, "") is None
    with pytest.raises(ValueError):
        Updater("sometimes")


def test_provider_retries_tasks_and_batches(spark):
    asked = []

    def flaky(texts, task="passage"):
        asked.append((task, len(texts)))
        if len(asked) < 3:
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    assert embedding.retried(embedding.for_task(flaky, "query"), ["ab"], wait=0) == [[2.0]] and asked == [("query", 1)] * 3
    with pytest.raises(RuntimeError):
        embedding.retried(lambda texts: 1 / 0 if texts is None else (_ for _ in ()).throw(RuntimeError()), ["x"], tries=2, wait=0)
    with pytest.raises(ValueError):
        embedding.for_task(flaky, "other")
    assert [list(r) for r in embedding.batches([5, 5, 20, 1, 1, 1], 2, 10)] == [[0, 1], [2], [3, 4], [5]]
    assert list(embedding.batches([], 2)) == []


def test_sparse_providers(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta")], "doc_id long, text string")
    logits = lambda rows: rows.select("doc_id", F.lit("t").alias("term"), F.lit(1.0).alias("logit"))

    def refuse(_):
        raise RuntimeError("no model")

    assert {r.term for r in retrieval.sparse_embed(docs, "doc_id", "text", "learned", logits).collect()} == {"t"}
    for more in ({"provider": "learned", "learned": refuse}, {"provider": "learned"}, {}):
        assert {r.term for r in retrieval.sparse_embed(docs, "doc_id", "text", **more).collect()} == {"alpha", "beta"}
    with pytest.raises(ValueError):
        retrieval.sparse_embed(docs, "doc_id", "text", "other")


def test_dense_many_leaves_out_broken_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = retrieval.dense_topk_many(rows, rows, 2).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert retrieval.dense_topk_many(rows, rows.filter("vec_id = 2"), 2).count() == 0


def test_search_groups_agree_with_single_ones(spark):
    """One pass over all repositories gives each repository's own lists."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    many = retrieval.bm25_by_group(docs, "the erin", 5, "doc_id", "text", "source")
    for source in [r.source for r in docs.select("source").distinct().orderBy("source").limit(3).collect()]:
        one_ = retrieval.bm25_topk(docs.filter(F.col("source") == source), "the erin", 5)
        assert [(r.doc_id, round(r.score, 6)) for r in many.filter(F.col("source") == source).orderBy("rank").collect()] == [(r.doc_id, round(r.score, 6)) for r in one_.collect()]


def test_prompt(spark):
    rows = spark.createDataFrame([("e1", "Function", "m::f", "semantic", None, None, 0.91, "x"), ("e2", "Class", "m::C", "graph", "e1", "CALLS", 0.5, None)], "entity_id string, entity_type string, qualified_name string, source string, origin string, relation string, score double, content string")
    assert agentic.prompt(rows, 2) == "[e1] Function: m::f\nScore: 0.91\nJustification: Semantic match: 0.91\nContent: x\n\n---\n\n[e2] Class: m::C [via CALLS from e1]\nScore: 0.50\nJustification: Graph context\nContent: N/A"
    assert agentic.prompt(rows, 1).count("[") == 1


def test_ignore_rules_with_negation(spark):
    globs = files.ignore_patterns("# build\ntarget/\n*.log\n!keep.log\n/docs/*.md\n\n")
    paths = ["target/a.rs", "x/target/b.rs", "a.log", "d/keep.log", "docs/a.md", "x/docs/a.md", "src/target.rs"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r.path for r in rows.filter(changes.wanted(F.col("path"), F.lit(1), globs)).collect()}
    assert left == {"d/keep.log", "x/docs/a.md", "src/target.rs"}


def test_scans(spark):
    from codelode.operators import scans

    assert one(spark, *[scans.parse_qualified(F.lit(x)).alias(f"c{i}") for i, x in enumerate(["a::<T as q::Tr>::m", "<T>", "a::b"])])[:3] == (("trait_impl", "T", "q::Tr", "m"), ("inherent_impl", "T", None, None), ("simple", None, None, "b"))
    assert one(spark, scans.inside_root(F.lit("/r/a"), "/r/"), scans.inside_root(F.lit("/r/../x"), "/r"), scans.inside_root(F.lit("/rx"), "/r"), scans.is_child(F.lit("a::b"), F.lit("a")))[:4] == (True, False, False, True)
    repos = spark.createDataFrame([("1", "c1", 10.0, False, True), ("2", "c2", 20.0, False, False)], "repository_id string, collection_name string, bm25_avgdl double, graph_ready boolean, pending_relationship_resolution boolean")
    more = scans.ensure_repository(repos, spark.createDataFrame([("9", "c1", 0.0, False, False), ("3", "c3", 0.0, False, False)], repos.schema))
    assert {(r.repository_id, r.bm25_avgdl) for r in more.collect()} == {("1", 10.0), ("2", 20.0), ("3", 50.0)}
    assert {r.repository_id for r in scans.set_flags(repos, ["2"], graph_ready=True).filter("graph_ready").collect()} == {"2"}
    snaps = spark.createDataFrame([("r", "f", ["a", "b"]), ("r", "g", ["c"])], "repository_id string, file_path string, entity_ids array<string>")
    ents = spark.createDataFrame([("r", x, None) for x in "abc"], "repository_id string, entity_id string, deleted_at string")
    left = scans.delete_files(ents, snaps, snaps.filter("file_path = 'f'"), F.lit("now"))
    assert {r.entity_id for r in ingest.live(left).collect()} == {"c"}
    assert {r.entity_id for r in ingest.stale_ids(snaps, spark.createDataFrame([("r", "f", ["b"])], snaps.schema), ["repository_id", "file_path"]).collect()} == {"a"}
    log = spark.createDataFrame([('{"a": {"b": 5}}',), ("broken",), (None,)], "payload string")
    assert [r.field for r in scans.payload_field(log, "$.a.b", "int").collect()] == [5, None, None]


def test_resolve_pending_replaces_edges(spark):
    from codelode.operators import scans

    rows = spark.createDataFrame([entity("1", "run", "p::run", calls=[("p::stop", False)]), entity("2", "stop", "p::stop")], ENTITY).withColumn("deleted_at", F.lit(None).cast("string"))
    repos = spark.createDataFrame([("r", False, True), ("s", True, False)], "repository_id string, graph_ready boolean, pending_relationship_resolution boolean")
    old = spark.createDataFrame([("r", "2", "1", "CALLS"), ("s", "x", "y", "CALLS")], "repository_id string, src string, dst string, rel_type string")
    edges, _, done = scans.resolve_pending(spark, rows, repos, old)
    assert {tuple(r) for r in edges.collect()} == {("r", "1", "2", "CALLS"), ("s", "x", "y", "CALLS")}
    assert done.filter("graph_ready AND NOT pending_relationship_resolution").count() == 2


def test_extraction_is_dealt_out(spark):
    """A small file of many rows is not one task; references of several fields come from one pass; only wanted columns are made."""
    from codelode import queries_more as q
    from codelode.operators.tables import dealt

    files = q._files(spark.range(2000).coalesce(1), "id", "src/c", ".rs", q.RUST, "shop")
    assert files.rdd.getNumPartitions() > 1 and dealt(spark.range(50).coalesce(1), most=10).rdd.getNumPartitions() == 5
    rows = extract.extract_table(files, ["qualified_name", "relationships"])
    assert rows.columns == ["qualified_name", "relationships"]
    found = q._references(rows, "calls", "uses_types")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and found.count() == 2000 * 6


def test_extract_lines_and_documentation(spark):
    """Line numbers, documentation and content of the table, also where a worker gives rows out in pieces."""
    source = "\n/// First\n/// line\n#[inline]\nfn a() {\n}\nfn b() {}\n" + "fn c() {}\n" * extract.HELD_ROWS
    files = spark.createDataFrame([("r", "src/x.rs", source, "p"), ("r", "src/y.rs", None, "p")], "repository_id string, path string, content string, package string")
    rows = extract.extract_table(files).select("name", "start_line", "end_line", "documentation_summary", "content").collect()
    assert len(rows) == extract.HELD_ROWS + 2 and tuple(rows[0]) == ("a", 5, 6, "First\nline", "fn a() {\n}") and tuple(rows[1]) == ("b", 7, 7, None, "fn b() {}")
    assert rows[-1].start_line == extract.HELD_ROWS + 7


def test_cycles_are_ordered_as_written(spark):
    """Cut off by the path as it is written, in which `a>` comes after `a1`."""
    names = ["a", "a1", "a2"]
    edges, nodes = make(spark, [(x, y) for x in names for y in names if x != y], "IMPORTS", dict.fromkeys(names, "Module"))
    whole = sorted((r.length, ">".join(r.path)) for r in graph.cycles(edges, nodes, 3, limit=None).collect())
    for length in (3, None):
        assert [(r.length, ">".join(r.path)) for r in graph.cycles(edges, nodes, length, limit=3).collect()] == whole[:3]


def test_node_delete_leaves_supplier_zero(spark, tmp_path):
    """A supplier of key 0 is not the deleted part of key 0."""
    from codelode.queries import QUERIES

    spark.createDataFrame([(0, 50), (1, 5)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, 0, "A"), (1, 0, "A"), (1, 1, "R")], "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, QUERIES["node_delete"](spark, str(tmp_path)).collect())) == [("A", 1), ("R", 1)]


def test_drain_goes_by_batches(spark):
    """Every batch is the oldest rows left, those tried in vain included, and its outcome is settled without the rest of the log."""
    rows = [(f"{i:03}", dt.datetime(2024, 1, 1, 0, 0, i % 50), "graph", "c", dt.datetime(2024, 1, 1) if i % 9 == 0 else None, i % 4, None, i % 5 == 0) for i in range(60)]
    log = spark.createDataFrame(rows, "outbox_id string, created_at timestamp, target_store string, collection_name string, processed_at timestamp, retry_count int, last_error string, bad boolean")
    seen, want = [], []
    outcome = lambda batch: batch.select("outbox_id", F.when(F.col("bad"), "no").alias("error"))
    whole, dead = changes.drain(log, lambda batch: seen.append(sorted(r.outbox_id for r in batch.collect())), outcome, F.lit("2030-01-01").cast("timestamp"), batch=7)
    open_, retries = [r for r in rows if r[4] is None and r[5] < 3], {r[0]: r[5] for r in rows}
    while open_:
        now = sorted(open_, key=lambda r: (r[1], r[0]))[:7]
        want.append(sorted(r[0] for r in now))
        for r in now:
            retries[r[0]] += r[7]
        open_ = [r for r in open_ if r not in now or (r[7] and retries[r[0]] < 3)]
    assert seen == want
    assert {r.outbox_id: r.retry_count for r in whole.collect()} == retries and whole.count() == 60
    assert {r.outbox_id for r in dead.collect()} == {r[0] for r in rows if r[7] and r[4] is None and r[5] < 3}
    assert whole.filter("processed_at IS NULL").count() == sum(r[4] is None and r[5] >= 3 for r in rows)
    settled = []
    per_step = lambda batch: settled.append(batch.sparkSession) or outcome(batch)
    plans, settle = [], changes.settle
    changes.settle = lambda hand, *rest: plans.append(hand.count()) or settle(hand, *rest)
    try:
        changes.drain(log, lambda batch: None, per_step, F.lit("2030-01-01").cast("timestamp"), batch=7)
    finally:
        changes.settle = settle
    assert len(settled) == len(want) and max(plans) < 14


def test_dense_many_in_blocks(spark, monkeypatch):
    """Blocks smaller than both sides give the exact best; equal vectors have equal scores, so ids decide."""
    import math
    import random

    monkeypatch.setattr(retrieval, "BLOCK_SIDE", 7)
    dice = random.Random(5)
    base = [[dice.uniform(-1, 1) for _ in range(9)] for _ in range(30)]
    rows = [(i, base[i % 30] if i % 3 else [2 * x for x in base[i % 30]]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    want = {(q, i, n) for q, a in rows if q % 4 == 0 for n, (_, i) in enumerate(sorted((-round(cos(a, b), 12), i) for i, b in rows)[:6], 1)}
    found = retrieval.dense_topk_many(vectors, vectors.filter("vec_id % 4 = 0"), 6)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want


def test_names_are_resolved_once(spark):
    """References look up names that were resolved without them, however many name one; a missing target or simple name is no match."""
    entities = spark.createDataFrame([entity("1", "b", "p::b"), entity("2", "b", "<p::T as p::U>::b", "Method")], ENTITY)
    rows = [("r", f"s{i}", "CALLS", t, s, e) for i in range(20) for t, s, e in (("x::b", "b", False), ("ext::c<T>", "c", True), (None, "b", False), ("p::b", None, False), (None, None, False))]
    refs = spark.createDataFrame(rows, "repository_id string, src string, rel_type string, target string, simple string, is_external boolean")
    edges, outside = resolve.resolve(entities, refs)
    assert {(r.src, r.dst) for r in edges.collect()} == {(f"s{i}", d) for i in range(20) for d in ("1", "external::ext::c")} and edges.count() == 40
    assert [tuple(r) for r in outside.collect()] == [("external::ext::c", "r", "external::ext::c", "c", "ext")]
    assert "posexplode" not in edges._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("common", [100_000, 3, 0])
def test_top_terms_of_few_rows(spark, monkeypatch, common):
    """However few terms' frequencies are known beforehand, the heaviest are exact, ties by term; only some terms are shuffled."""
    import math
    import random

    monkeypatch.setattr(retrieval, "COMMON_TERMS", common)
    dice = random.Random(3)
    texts = [" ".join(f"w{min(int(dice.expovariate(0.05)), 90)}" for _ in range(dice.choice((0, 3, 60)))) for _ in range(40)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    count = [{t: x.split().count(t) for t in x.split()} if x else {} for x in texts]
    df = {t: sum(t in c for c in count) for c in count for t in c}
    idf = {t: math.log((41 - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    want = {(i, t, n) for i, c in enumerate(count) for n, (_, t) in enumerate(sorted((-round(c[t] * idf[t], 6), t) for t in c)[:4], 1)}
    assert {(r.id, r.term, r["rank"]) for r in retrieval.top_terms(docs, "id", "text", 4).collect()} == want
    if common:
        assert retrieval._heavy_terms(docs, "id", "text", 4, 41).count() < sum(map(len, count))
    halves = docs.union(docs).withColumn("text", F.coalesce("text", F.lit("")))  # a document in two rows counts as before
    assert retrieval.top_terms(halves, "id", "text", 4).filter("id = 0 AND rank = 1").count() == (1 if count[0] else 0)


def test_files_that_go_while_they_are_read(spark, tmp_path):
    (tmp_path / "a.rs").write_text("fn a() {}")
    (tmp_path / "b.rs").write_text("fn b() {}")
    rows = files.repository_files(spark, str(tmp_path), "r")
    (tmp_path / "b.rs").unlink()
    assert [r.path for r in rows.collect()] == ["a.rs"]
