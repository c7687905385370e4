"""Registered queries of the engine's own operators over the driver tables, each with its SQL.

Stand-ins: documents are entities (language, repository = source), embeddings are
dense vectors, orders and lineitem give typed edges between parts, regions,
nations and customers give containment, events give changes.  Every query works
on its whole tables; limits are top-k reports only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import evaluate, graph, ingest, resolve, retrieval, scans
from codelode.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUERY_TEXT = "the erin that ation"
PART, MODULE, CLASS, TRAIT = "part7", "AFRICA", "Customer#000000001", "Brand#13"

# Tokens in SQL: marks where words are cut, then one pattern.
_W = r"[\p{L}\p{N}\p{M}_\x1f]+(?:[.''’][\p{L}\p{N}\p{M}_\x1f]+)*"
TOKENS = (
    r"list_transform(list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(regexp_replace({x}, '(\p{Ll})(\p{Lu})', '\1' || chr(31) || '\2', 'g'), "
    r"'(\p{Lu})(\p{Lu}\p{Ll})', '\1' || chr(31) || '\2', 'g'), '" + _W + r"'), lambda w: string_split(replace(w, '_', chr(31)), chr(31)))), lambda t: t <> ''), lambda t: lower(t))"
)
TOK = TOKENS.replace("{x}", "text")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- dense search


def _first_vector(spark, sf) -> list[float]:
    return table(spark, sf, "embeddings").filter("vec_id = 0").first().embedding


COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS} DESC, e.vec_id LIMIT 10")
def knn_cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    return retrieval.dense_topk(rows, _first_vector(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 3) ORDER BY {COS} DESC, e.vec_id LIMIT 10")
def knn_filtered(spark, sf):
    rows = retrieval.metadata_filter(table(spark, sf, "embeddings"), kinds=[1, 3], kind="label")
    return retrieval.dense_topk(rows, _first_vector(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(
    f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""
)
def knn_batch_topk(spark, sf):
    """The search's stated queries (ids divisible by 100) against all rows."""
    rows = table(spark, sf, "embeddings")
    return retrieval.dense_topk_many(rows, rows.filter("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 6))


# ---- text and sparse search


@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct FROM (SELECT doc_id, {TOK} AS t FROM documents)")
def tokenize_counts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", X.code_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT source, CAST(sum(n) AS BIGINT) AS total_tokens, count(*) AS n_entities, sum(n) / count(*) AS avgdl FROM (SELECT source, len({TOK}) AS n FROM documents) GROUP BY source")
def bm25_corpus_stats(spark, sf):
    return retrieval.corpus_stats(table(spark, sf, "documents"), "source", "text")


IDF_SQL = f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term"


@query(f"SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM ({IDF_SQL}), (SELECT count(*) AS n FROM documents)")
def idf_table(spark, sf):
    return retrieval.idf_table(table(spark, sf, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 6))


def bm25_sql(where: str = "", limit: int = 10) -> str:
    return f"""WITH d AS (SELECT doc_id, source, lang, {TOK} AS t FROM documents {where}),
    a AS (SELECT source, avg(len(t)) AS avgdl FROM d GROUP BY source),
    q AS (SELECT unnest(string_split('{QUERY_TEXT}', ' ')) AS term),
    tf AS (SELECT doc_id, source, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
    s AS (SELECT doc_id, sum(ln(((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
          FROM tf JOIN df USING (term) JOIN a USING (source) WHERE tf > 0 GROUP BY doc_id)
    SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT {limit}"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({bm25_sql()})")
def bm25_topk(spark, sf):
    return retrieval.bm25_topk(table(spark, sf, "documents"), QUERY_TEXT, 10).withColumn("score", F.round("score", 6))


@query(
    f"""WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY doc_id, term),
    i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM ({IDF_SQL}), (SELECT count(*) AS n FROM documents))
    SELECT doc_id, term, round(tf * idf, 6) AS weight, rank FROM (SELECT doc_id, term, tf, idf, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * idf, 6) DESC, term) AS rank FROM c JOIN i USING (term)) WHERE rank <= 5"""
)
def sparse_topk_terms(spark, sf):
    return retrieval.top_terms(table(spark, sf, "documents"), "doc_id", "text", 5).withColumn("weight", F.round("weight", 6))


# ---- fusion and filters


def _dense_docs(spark, sf, docs, limit):
    near = retrieval.dense_topk(table(spark, sf, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), _first_vector(spark, sf), limit)
    return near.withColumnRenamed("vec_id", "doc_id")


def dense_sql(where: str, limit: int) -> str:
    return f"""SELECT e.vec_id AS doc_id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE e.vec_id IN (SELECT doc_id FROM documents {where}) ORDER BY score DESC, doc_id LIMIT {limit}"""


def fusion_sql(where: str = "", limit: int = 10, more: str = "") -> str:
    r = "1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id))"
    return f"""SELECT doc_id, round(sum(part), 8) AS score FROM (SELECT doc_id, {r} AS part FROM ({bm25_sql(where, 50)}) UNION ALL SELECT doc_id, {r} FROM ({dense_sql(where, 50)}))
    {more} GROUP BY doc_id ORDER BY sum(part) DESC, doc_id LIMIT {limit}"""


def _hybrid(spark, sf, docs, limit=10):
    n = retrieval.prefetch(limit)
    return retrieval.fuse([retrieval.bm25_topk(docs, QUERY_TEXT, n), _dense_docs(spark, sf, docs, n)], limit, "doc_id").withColumn("score", F.round("score", 8))


@query(fusion_sql())
def rrf_fusion(spark, sf):
    return _hybrid(spark, sf, table(spark, sf, "documents"))


@query(fusion_sql("WHERE lang = 'en'"))
def hybrid_filtered(spark, sf):
    """The filter stands before both lists, so it reaches the scan."""
    return _hybrid(spark, sf, retrieval.metadata_filter(table(spark, sf, "documents"), language="en", lang="lang"))


GOOD = "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT page_id FROM pages WHERE contains(url, '/en/'))"


@query(fusion_sql(GOOD))
def hybrid_structural(spark, sf):
    """Only documents in both structural sets, filtered before ranking."""
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    paged = table(spark, sf, "pages").filter(F.contains("url", F.lit("/en/"))).select(F.col("page_id").alias("doc_id"))
    return _hybrid(spark, sf, retrieval.structural_filter(table(spark, sf, "documents"), [good, paged], "doc_id"))


@query(
    f"""WITH a AS ({bm25_sql("WHERE lang = 'en'", 20)}), b AS ({bm25_sql("WHERE lang <> 'en'", 20)})
    SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY score DESC, doc_id LIMIT 20"""
)
def multi_repo_merge(spark, sf):
    docs = table(spark, sf, "documents")
    lists = [retrieval.bm25_topk(docs.filter(c), QUERY_TEXT, 20) for c in ("lang = 'en'", "lang <> 'en'")]
    return retrieval.merge_lists(lists, 20, "doc_id").withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, p_retailprice / p_size AS score FROM part ORDER BY (p_size % 7 = 0), CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice / p_size END DESC, p_partkey LIMIT 25")
def rerank_nan_last(spark, sf):
    """New scores are NaN for some parts; those come last (and here never into the first 25)."""
    parts = table(spark, sf, "part").select("p_partkey", F.lit(0.0).alias("score"))
    new = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice") / F.col("p_size")).alias("score"))
    return retrieval.rerank(parts, new, 25, "p_partkey")


# ---- graph

NODES_SQL = """SELECT 'p' || p_partkey AS id, p_name AS name, 'part' || p_partkey AS qualified_name, CASE p_size % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'Method' ELSE 'Class' END AS kind,
 CASE WHEN p_size % 2 = 0 THEN 'Private' ELSE 'Public' END AS visibility FROM part
 UNION ALL SELECT 'r' || r_regionkey, r_name, r_name, 'Module', 'Public' FROM region
 UNION ALL SELECT 'n' || n_nationkey, n_name, n_name, 'Module', 'Public' FROM nation
 UNION ALL SELECT 'c' || c_custkey, c_name, c_name, CASE WHEN c_acctbal >= 0 THEN 'Function' ELSE 'Class' END, 'Public' FROM customer
 UNION ALL SELECT 's' || s_suppkey, s_name, s_name, 'Impl', 'Public' FROM supplier
 UNION ALL SELECT DISTINCT 'b' || p_brand, p_brand, p_brand, 'Trait', 'Public' FROM part"""
EDGES_SQL = """SELECT DISTINCT 'r' AS repository_id, src, dst, rel_type FROM (
 SELECT 'p' || l_partkey AS src, 'p' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'CALLS' ELSE 'USES' END AS rel_type FROM lineitem
 UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'CONTAINS' FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS' FROM customer
 UNION ALL SELECT 'n' || c_nationkey, 'n' || s_nationkey, 'IMPORTS' FROM customer JOIN supplier ON c_custkey = s_suppkey
 UNION ALL SELECT 's' || l_suppkey, 'b' || p_brand, 'IMPLEMENTS' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity = 50
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'ASSOCIATES' FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'INHERITS_FROM' FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'INHERITS_FROM' FROM nation
) WHERE dst IS NOT NULL"""


def nodes(spark, sf) -> DataFrame:
    t = lambda name: table(spark, sf, name)
    rows = lambda df, p, key, name, kind, qualified=None, vis=None: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), (qualified if qualified is not None else F.col(name)).alias("qualified_name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (vis if vis is not None else F.lit("Public")).alias("visibility"))
    size = F.col("p_size")
    parts = rows(t("part"), "p", "p_partkey", "p_name", F.when(size % 3 == 0, "Function").when(size % 3 == 1, "Method").otherwise("Class"), F.concat(F.lit("part"), "p_partkey"), F.when(size % 2 == 0, "Private").otherwise("Public"))
    parts = parts.union(rows(t("region"), "r", "r_regionkey", "r_name", "Module")).union(rows(t("nation"), "n", "n_nationkey", "n_name", "Module"))
    parts = parts.union(rows(t("customer"), "c", "c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, "Function").otherwise("Class"))).union(rows(t("supplier"), "s", "s_suppkey", "s_name", "Impl"))
    return parts.union(rows(t("part").select("p_brand").distinct(), "b", "p_brand", "p_brand", "Trait"))


def edges(spark, sf, *kinds: str) -> DataFrame:
    """Typed edges; only the tables of the wanted kinds are read."""
    t = lambda name: table(spark, sf, name)
    link = lambda df, a, x, b, y, kind: df.select(F.lit("r").alias("repository_id"), F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("rel_type"))
    made = {
        "CONTAINS": lambda: link(t("nation"), "r", "n_regionkey", "n", "n_nationkey", "CONTAINS").union(link(t("customer"), "n", "c_nationkey", "c", "c_custkey", "CONTAINS")),
        "IMPORTS": lambda: link(t("customer").join(t("supplier"), F.col("c_custkey") == F.col("s_suppkey")), "n", "c_nationkey", "n", "s_nationkey", "IMPORTS"),
        "IMPLEMENTS": lambda: link(t("lineitem").filter("l_returnflag = 'R' AND l_quantity = 50").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "s", "l_suppkey", "b", "p_brand", "IMPLEMENTS"),
        "ASSOCIATES": lambda: link(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "ASSOCIATES"),
        "INHERITS_FROM": lambda: link(t("customer"), "c", "c_custkey", "n", "c_nationkey", "INHERITS_FROM").union(link(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "INHERITS_FROM")),
    }
    out = None
    if "CALLS" in kinds or "USES" in kinds:
        following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
        rows = t("lineitem").select("l_partkey", "l_returnflag", "l_quantity", following.alias("next")).filter("next IS NOT NULL")
        out = link(rows, "p", "l_partkey", "p", "next", F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), "CALLS").otherwise("USES")).filter(F.col("rel_type").isin(*kinds))
    for kind in kinds:
        if kind in made:
            out = made[kind]() if out is None else out.union(made[kind]())
    return out.distinct()


def walk_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE n AS ({NODES_SQL}), e AS (SELECT DISTINCT src, dst FROM ({EDGES_SQL}) WHERE rel_type = 'CALLS'),
    t AS (SELECT {b} AS node, 1 AS depth, [src || '>' || dst] AS path FROM e WHERE {a} IN (SELECT id FROM n WHERE qualified_name = '{PART}')
      UNION ALL SELECT e.{b}, depth + 1, list_append(path, src || '>' || dst) FROM t JOIN e ON t.node = e.{a} WHERE depth < 3 AND NOT list_contains(path, src || '>' || dst))
    SELECT DISTINCT n.qualified_name, depth FROM t JOIN n ON t.node = n.id"""


@query(walk_sql("dst", "src"))
def callers_depth3(spark, sf):
    return graph.callers(edges(spark, sf, "CALLS"), nodes(spark, sf), PART, 3)


@query(walk_sql("src", "dst"))
def callees_depth3(spark, sf):
    return graph.callees(edges(spark, sf, "CALLS"), nodes(spark, sf), PART, 3)


@query(f"SELECT c_name AS qualified_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{MODULE}' AND c_acctbal >= 0")
def module_contents(spark, sf):
    return graph.contents(edges(spark, sf, "CONTAINS"), nodes(spark, sf), MODULE)


@query(f"SELECT DISTINCT n.qualified_name FROM ({EDGES_SQL}) e JOIN ({NODES_SQL}) n ON e.dst = n.id WHERE e.rel_type = 'IMPORTS' AND e.src = (SELECT 'n' || n_nationkey FROM nation WHERE n_name = 'NATION_2')")
def module_dependencies(spark, sf):
    return graph.dependencies(edges(spark, sf, "IMPORTS"), nodes(spark, sf), "NATION_2")


@query(f"SELECT p.p_brand AS trait_name, n_name AS type_name FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity = 50) p JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_brand = '{TRAIT}'")
def trait_implementations(spark, sf):
    return graph.implementations(edges(spark, sf, "IMPLEMENTS", "ASSOCIATES"), nodes(spark, sf), TRAIT)


@query(
    """WITH RECURSIVE i AS (SELECT 'c' || c_custkey AS src, c_name AS a, 'c' || (c_custkey - 1) AS dst FROM customer WHERE c_custkey % 5 > 0),
    t AS (SELECT dst, [c_name] AS path FROM i JOIN customer ON i.src = 'c' || c_custkey WHERE c_name = 'Customer#000000004'
      UNION ALL SELECT i.dst, list_append(path, i.a) FROM t JOIN i ON t.dst = i.src)
    SELECT array_to_string(list_append(path, c_name), '>') AS path FROM t JOIN customer ON t.dst = 'c' || c_custkey"""
)
def class_hierarchy(spark, sf):
    """Chains of five customers each: every ancestor path of one of them."""
    customers = table(spark, sf, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    up = customers.filter("c_custkey % 5 > 0").select(F.lit("r").alias("repository_id"), name.alias("src"), F.concat(F.lit("c"), (F.col("c_custkey") - 1).cast("string")).alias("dst"), F.lit("INHERITS_FROM").alias("rel_type"))
    classes = customers.select(name.alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("qualified_name"), F.lit("Class").alias("kind"))
    return graph.hierarchy(up, classes, "Customer#000000004").select(F.array_join("path", ">").alias("path"))


@query(f"SELECT qualified_name FROM ({NODES_SQL}) f WHERE kind = 'Function' AND visibility = 'Private' AND id NOT IN (SELECT e.dst FROM ({EDGES_SQL}) e JOIN ({NODES_SQL}) c ON e.src = c.id WHERE e.rel_type = 'CALLS' AND c.kind IN ('Function', 'Method'))")
def unused_functions(spark, sf):
    return graph.unused(edges(spark, sf, "CALLS"), nodes(spark, sf))


def cycle_sql(bag: bool) -> str:
    base = f"""WITH RECURSIVE e AS (SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM ({EDGES_SQL}) x JOIN nation a ON x.src = 'n' || a.n_nationkey JOIN nation b ON x.dst = 'n' || b.n_nationkey WHERE rel_type = 'IMPORTS'),
    t AS (SELECT a AS start_, b AS node, [a || '>' || b] AS used, [b] AS trail, 1 AS n FROM e
      UNION ALL SELECT start_, e.b, list_append(used, e.a || '>' || e.b), list_append(trail, e.b), n + 1 FROM t JOIN e ON t.node = e.a WHERE n < 3 AND NOT list_contains(used, e.a || '>' || e.b)),
    c AS (SELECT list_prepend(start_, trail) AS path, n AS length, start_, trail[1:n - 1] AS inner_ FROM t WHERE node = start_)"""
    if bag:
        return base + " SELECT array_to_string(path, '>') AS path, length FROM (SELECT path, length, start_, unnest(inner_) AS mid FROM c) WHERE mid <> start_ ORDER BY length, path LIMIT 100"
    return base + " SELECT array_to_string(path, '>') AS path, length FROM c WHERE len(inner_) > 0 AND len(list_filter(inner_, lambda x: x <= start_)) = 0"


@query(cycle_sql(True))
def circular_dependencies(spark, sf):
    """The report's first 100 closed trails by length."""
    return graph.cycles(edges(spark, sf, "IMPORTS"), nodes(spark, sf), 3).withColumn("path", F.array_join("path", ">"))


@query(cycle_sql(False))
def circular_canonical(spark, sf):
    return graph.cycles(edges(spark, sf, "IMPORTS"), nodes(spark, sf), 3, canonical=True, limit=None).withColumn("path", F.array_join("path", ">"))


@query(f"SELECT e.* FROM ({EDGES_SQL}) e WHERE rel_type IN ('CALLS', 'IMPLEMENTS') AND src IN (SELECT id FROM ({NODES_SQL}) WHERE kind <> 'Class') AND dst IN (SELECT id FROM ({NODES_SQL}) WHERE kind <> 'Class')")
def edge_upsert(spark, sf):
    """Edges are kept only where both ends exist (here: nodes that are no class)."""
    return graph.valid_edges(edges(spark, sf, "CALLS", "USES", "IMPLEMENTS"), nodes(spark, sf).filter("kind <> 'Class'"), ["CALLS", "IMPLEMENTS"])


@query(f"SELECT kind, CASE kind WHEN 'Impl' THEN 'Entity,ImplBlock' WHEN 'Trait' THEN 'Entity,Trait,Interface' ELSE 'Entity,' || kind END AS labels, count(*) AS n FROM ({NODES_SQL}) GROUP BY kind")
def node_labels(spark, sf):
    return nodes(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.array_join(graph.labels(F.col("kind")), ",").alias("labels"), "n")


# ---- resolution


@query("SELECT 'r' AS repository_id, 'n' || n_nationkey AS src, 'c' || c_custkey AS dst, 'CONTAINS' AS rel_type FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'r', 'r' || r_regionkey, 'n' || n_nationkey, 'CONTAINS' FROM nation JOIN region ON n_regionkey = r_regionkey")
def contains_edges(spark, sf):
    t = lambda name: table(spark, sf, name)
    row = lambda df, p, key, name, scope: df.select(F.lit("r").alias("repository_id"), F.concat(F.lit(p), F.col(key).cast("string")).alias("entity_id"), F.col(name).alias("qualified_name"), scope.alias("parent_scope"))
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    whole = row(t("region"), "r", "r_regionkey", "r_name", F.lit(None).cast("string")).union(row(nation, "n", "n_nationkey", "n_name", F.col("r_name"))).union(row(customer, "c", "c_custkey", "c_name", F.col("n_name")))
    return resolve.contains_edges(whole)


def _part_entities(spark, sf):
    refs = "array<struct<target:string,simple_name:string,is_external:boolean>>"
    return table(spark, sf, "part").select(
        F.lit("r").alias("repository_id"),
        F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("entity_id"),
        F.col("p_name").alias("name"),
        F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"),
        F.lit(None).cast("string").alias("path_entity_identifier"),
        F.when(F.col("p_size") % 4 == 0, "Class").otherwise("Function").alias("entity_type"),
        F.struct(F.lit(None).cast(refs).alias("calls"), F.array(F.concat(F.lit("alias::"), F.col("p_type"), F.col("p_size").cast("string"))).alias("call_aliases")).alias("relationships"),
    )


def _order_refs(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber") % 4
    target = F.when(n == 0, F.concat_ws("::", "p_brand", "p_name")).when(n == 1, F.concat(F.lit("alias::"), F.col("p_type"), F.col("p_size").cast("string"))).when(n == 2, F.concat(F.lit("other::"), F.col("p_name"))).otherwise(F.concat(F.lit("crate::ext::"), F.col("l_returnflag"), F.lit("<T>")))
    return rows.select(F.lit("r").alias("repository_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("CALLS").alias("rel_type"), target.alias("target"), X.simple_name(target).alias("simple"), (n == 3).alias("is_external"))


_REFS = """SELECT DISTINCT 's' || l_suppkey AS src, CASE l_linenumber % 4 WHEN 0 THEN p_brand || '::' || p_name WHEN 1 THEN 'alias::' || p_type || p_size WHEN 2 THEN 'other::' || p_name ELSE 'ext::' || l_returnflag END AS target,
 CASE l_linenumber % 4 WHEN 1 THEN p_type || p_size WHEN 3 THEN l_returnflag ELSE p_name END AS simple, l_linenumber % 4 = 3 AS is_external FROM lineitem JOIN part ON l_partkey = p_partkey"""
_ENT = "SELECT 'p' || lpad(p_partkey::VARCHAR, 9, '0') AS id, p_name AS name, p_brand || '::' || p_name AS q, 'alias::' || p_type || p_size AS alias FROM part WHERE p_size % 4 <> 0"


@query(
    f"""WITH r AS ({_REFS}), e AS ({_ENT}), q AS (SELECT q AS k, min(id) AS id FROM e GROUP BY q), a AS (SELECT alias AS k, min(id) AS id FROM e GROUP BY alias), s AS (SELECT name AS k, min(id) AS id FROM e GROUP BY name),
    j AS (SELECT r.*, coalesce(q.id, a.id, s.id) AS dst FROM r LEFT JOIN q ON q.k = r.target LEFT JOIN a ON a.k = r.target LEFT JOIN s ON s.k = r.simple)
    SELECT DISTINCT 'r' AS repository_id, src, coalesce(dst, 'external::' || target) AS dst, 'CALLS' AS rel_type FROM j WHERE dst IS NOT NULL OR is_external"""
)
def resolve_cascade(spark, sf):
    return resolve.resolve(_part_entities(spark, sf), _order_refs(spark, sf))[0]


@query("SELECT DISTINCT 'external::ext::' || l_returnflag AS id, 'r' AS repository_id, 'external::ext::' || l_returnflag AS qualified_name, l_returnflag AS name, 'ext' AS package FROM lineitem WHERE l_linenumber % 4 = 3")
def external_refs(spark, sf):
    return resolve.resolve(_part_entities(spark, sf), _order_refs(spark, sf))[1]


@query("SELECT name, count(*) AS n, min(id) AS first, CASE WHEN count(*) = 1 THEN min(id) END AS unique_id FROM (SELECT p_name || p_size AS name, p_partkey AS id FROM part) GROUP BY name")
def unique_simple_name(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_name", F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("entity_id"))
    return resolve.unique_names(rows)


PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(
    f"""WITH f AS (SELECT DISTINCT {PATH} AS path FROM pages), p AS (SELECT regexp_extract({PATH}, '^[^/]*') AS directory, count(*) AS n FROM pages GROUP BY 1
      UNION ALL SELECT regexp_extract({PATH}, '^[^/]*/[^/]*') AS directory, count(*) FROM pages WHERE contains({PATH}, '/en/') GROUP BY 1)
    SELECT path, directory, n FROM (SELECT f.path, p.directory, p.n, row_number() OVER (PARTITION BY f.path ORDER BY length(p.directory) DESC) AS k FROM f LEFT JOIN p ON starts_with(f.path, p.directory || '/')) WHERE k = 1"""
)
def longest_prefix_package(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    files = table(spark, sf, "pages").select(path.alias("path"))
    hosts = files.groupBy(F.regexp_extract("path", "^[^/]*", 0).alias("directory")).agg(F.count(F.lit(1)).alias("n"))
    english = files.filter(F.contains("path", F.lit("/en/"))).groupBy(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("directory")).agg(F.count(F.lit(1)).alias("n"))
    return resolve.longest_prefix(files, hosts.union(english)).select("path", "directory", "n")


# ---- ingest and change log


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedup_keep_last(spark, sf):
    return ingest.keep_last(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query("WITH c AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE lang = 'en') SELECT d.lang, count(*) FILTER (WHERE c.h IS NOT NULL) AS hits, count(*) FILTER (WHERE c.h IS NULL) AS misses FROM documents d LEFT JOIN c ON md5(d.text) = c.h GROUP BY d.lang")
def cache_hit_miss(spark, sf):
    wanted = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("content_hash"))
    cache = wanted.filter("lang = 'en'").select("content_hash").distinct()
    hits, misses = ingest.cache_probe(wanted, cache, ["content_hash"])
    both = hits.select("lang", F.lit(1).alias("hit")).union(misses.select("lang", F.lit(0).alias("hit")))
    return both.groupBy("lang").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


@query("SELECT operation, count(*) AS n FROM (SELECT CASE WHEN c_acctbal >= 0 THEN 'UPDATE' ELSE 'INSERT' END AS operation FROM (SELECT DISTINCT o_custkey + 100 AS k FROM orders) LEFT JOIN customer ON k = c_custkey) GROUP BY operation")
def upsert_classify(spark, sf):
    incoming = table(spark, sf, "orders").select((F.col("o_custkey") + 100).alias("k")).distinct()
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("deleted_at"))
    return ingest.classify(incoming, stored, ["k"]).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, doc_id AS entity_id FROM documents WHERE n_chars <= 1000 AND source IN (SELECT source FROM documents WHERE n_chars > 1000)")
def stale_entities(spark, sf):
    docs = table(spark, sf, "documents")
    snap = lambda df: df.groupBy("source").agg(F.collect_set("doc_id").alias("entity_ids"))
    return ingest.stale_ids(snap(docs), snap(docs.filter("n_chars > 1000")), ["source"])


@query("SELECT path, change FROM (SELECT coalesce(a.c_name, b.c_name) AS path, CASE WHEN a.c_name IS NULL THEN 'Added' WHEN b.c_name IS NULL THEN 'Deleted' WHEN a.m <> b.m THEN 'Modified' END AS change FROM (SELECT c_name, c_mktsegment AS m FROM customer WHERE c_nationkey <> 3) a FULL JOIN (SELECT c_name, CASE WHEN c_acctbal < 0 THEN 'X' ELSE c_mktsegment END AS m FROM customer WHERE c_nationkey <> 5) b ON a.c_name = b.c_name) WHERE change IS NOT NULL")
def manifest_diff(spark, sf):
    c = table(spark, sf, "customer")
    old = c.filter("c_nationkey <> 3").select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("blob"))
    new = c.filter("c_nationkey <> 5").select(F.col("c_name").alias("path"), F.when(F.col("c_acctbal") < 0, "X").otherwise(F.col("c_mktsegment")).alias("blob"))
    return ingest.manifest_diff(old, new)


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c_mktsegment")
def soft_delete_live_scan(spark, sf):
    rows = table(spark, sf, "customer").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    left = ingest.live(ingest.soft_delete(rows, gone, ["c_custkey"], F.lit("2024-01-01").cast("timestamp")))
    return left.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN x.k IS NULL THEN p_size ELSE x.v END AS p_size FROM part LEFT JOIN (SELECT l_partkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) x ON p_partkey = x.k")
def bulk_update(spark, sf):
    new = table(spark, sf, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("p_size"))
    return ingest.update_by_key(table(spark, sf, "part").select("p_partkey", "p_size"), new, ["p_partkey"])


def _outbox(spark, sf, *more) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("outbox_id"), F.col("ts").alias("created_at"), F.when(kind.isin("view", "click"), "graph").otherwise("vector").alias("target_store"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("collection_name"),
        F.when(kind == "signup", F.col("ts")).alias("processed_at"), (F.col("user_id") % 4).cast("int").alias("retry_count"), F.lit(None).cast("string").alias("last_error"), *more,
    )


_OUT = """SELECT lpad(event_id::VARCHAR, 12, '0') AS outbox_id, ts AS created_at, CASE WHEN event_type IN ('view', 'click') THEN 'graph' ELSE 'vector' END AS target_store, 'c' || (user_id % 7) AS collection_name, event_type = 'signup' AS done, user_id % 4 AS retry_count, event_type FROM events"""


@query(f"SELECT outbox_id, target_store, collection_name FROM ({_OUT}) WHERE NOT done AND retry_count < 3 ORDER BY created_at, outbox_id LIMIT 500")
def outbox_batch_order(spark, sf):
    """A batch is the oldest 500 rows: the limit is the operator's."""
    return ingest.claim(_outbox(spark, sf)).select("outbox_id", "target_store", "collection_name")


@query(f"SELECT outbox_id, CAST(retry_count + 1 AS INT) AS retry_count FROM ({_OUT}) WHERE NOT done AND event_type = 'error' AND retry_count + 1 >= 3")
def retry_dead_letter(spark, sf):
    log = _outbox(spark, sf)
    outcome = table(spark, sf, "events").filter("event_type <> 'signup'").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("outbox_id"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return ingest.settle(log, outcome, F.lit("2025-01-01").cast("timestamp"))[1].select("outbox_id", "retry_count")


@query("SELECT source, CAST(greatest(sum(n_chars * s), 0) AS BIGINT) AS total_tokens, CAST(greatest(sum(s), 0) AS BIGINT) AS n_entities, CASE WHEN sum(s) > 0 THEN greatest(sum(n_chars * s), 0) / sum(s) ELSE 50.0 END AS avgdl FROM (SELECT source, n_chars, 1 AS s FROM documents UNION ALL SELECT source, n_chars, -1 FROM documents WHERE lang <> 'en') GROUP BY source")
def bm25_incremental_stats(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("repository_id"), "lang", F.col("n_chars").alias("tokens"))
    none = spark.createDataFrame([], "repository_id string, total_tokens long, n_entities long, avgdl double")
    return ingest.add_stats(none, docs, docs.filter("lang <> 'en'")).withColumnRenamed("repository_id", "source")


@query("SELECT CAST(label AS VARCHAR) AS model_version, count(*) AS n, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes, min(vec_id) AS oldest, max(vec_id) AS newest FROM embeddings GROUP BY label")
def cache_stats(spark, sf):
    return ingest.cache_stats(table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("model_version"), "embedding", F.col("vec_id").alias("created_at")))


# ---- streams in batch form

KIND = {"view": "Modified", "click": "Modified", "purchase": "Created", "signup": "Deleted", "error": "PermissionsChanged"}
HOURS = 6


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS path, ts, CASE event_type WHEN 'purchase' THEN 'Created' WHEN 'signup' THEN 'Deleted' WHEN 'error' THEN 'PermissionsChanged' ELSE 'Modified' END AS kind,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    t AS (SELECT path, i, ts AS opened, ts AS last_ts, kind, 1 AS n, 1 AS w FROM e WHERE i = 1
      UNION ALL SELECT e.path, e.i, CASE WHEN e.ts < t.opened + INTERVAL {HOURS} HOUR THEN t.opened ELSE e.ts END, e.ts,
        CASE WHEN e.ts < t.opened + INTERVAL {HOURS} HOUR AND t.kind = 'Created' AND e.kind = 'Modified' THEN 'Created' ELSE e.kind END,
        CASE WHEN e.ts < t.opened + INTERVAL {HOURS} HOUR THEN t.n + 1 ELSE 1 END, CASE WHEN e.ts < t.opened + INTERVAL {HOURS} HOUR THEN t.w ELSE t.w + 1 END
      FROM t JOIN e ON e.path = t.path AND e.i = t.i + 1)
    SELECT path, opened AS window_start, last_ts, kind AS change_type, CAST(n AS BIGINT) AS n_events FROM t QUALIFY row_number() OVER (PARTITION BY path, w ORDER BY i DESC) = 1"""
)
def debounce_latest_wins(spark, sf):
    kinds = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])
    rows = table(spark, sf, "events").select(F.col("user_id").alias("path"), "ts", kinds[F.col("event_type")].alias("change_type"), "event_id")
    return changes.debounce(rows, HOURS * 3_600_000, "path", "ts", "change_type", "event_id")


@query("SELECT action, count(*) AS n FROM (SELECT unnest(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN ['index'] WHEN event_type = 'signup' THEN ['delete'] ELSE ['delete', 'index'] END) AS action FROM events) GROUP BY action")
def change_routing(spark, sf):
    kinds = F.create_map(*[F.lit(x) for pair in ({**KIND, "error": "Renamed"}).items() for x in pair])
    rows = table(spark, sf, "events").select(F.col("user_id").alias("path"), kinds[F.col("event_type")].alias("change_type"), (F.col("user_id") + 1).alias("new_path"))
    return changes.route(rows).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    return changes.tumbling(table(spark, sf, "events"), "1 day", "ts", "event_type")


@query(
    """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def session_counts(spark, sf):
    return changes.sessions(table(spark, sf, "events"), "4 hours", "user_id")


# ---- iterative search and evaluation


@query(
    f"""WITH d AS ({bm25_sql(limit=5)}), g AS (SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM d)) AND lang = 'es')
    SELECT doc_id, origin FROM (SELECT doc_id, 'direct' AS origin, 0 AS o FROM d UNION ALL SELECT doc_id, 'graph', 1 FROM g) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) = 1"""
)
def agentic_union_topn(spark, sf):
    """The five best direct hits, then all that the graph adds (here: Spanish documents of the same sources), each once."""
    from codelode.plans.agentic import combine

    docs = table(spark, sf, "documents")
    direct = retrieval.bm25_topk(docs, QUERY_TEXT, 5).select("doc_id")
    sources = docs.join(F.broadcast(direct), "doc_id", "left_semi").select("source").distinct()
    return combine(direct, docs.filter("lang = 'es'").join(sources, "source", "left_semi").select("doc_id"), "doc_id")


RANKS = "CASE WHEN quality = 0 THEN NULL ELSE doc_id % 13 + 1 END"


@query(f"SELECT avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) AS recall_at_1, avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END) AS recall_at_10, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr, count(r) AS n_found, count(*) - count(r) AS n_missing FROM (SELECT {RANKS} AS r FROM labels)")
def recall_mrr(spark, sf):
    rows = table(spark, sf, "labels").select(F.when(F.col("quality") != 0, F.col("doc_id") % 13 + 1).alias("rank"))
    return evaluate.recall_metrics(rows).withColumn("mrr", F.round("mrr", 6))


@query(
    """WITH j AS (SELECT source, d.doc_id, n_chars, quality * 2 + toxic AS rel FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY rel DESC, doc_id) AS b FROM j),
    s AS (SELECT source, sum(CASE WHEN a <= 10 THEN (pow(2, rel) - 1) / log2(a + 1) ELSE 0 END) AS d, sum(CASE WHEN b <= 10 THEN (pow(2, rel) - 1) / log2(b + 1) ELSE 0 END) AS i FROM p GROUP BY source)
    SELECT source, round(CASE WHEN i = 0 THEN 0 ELSE d / i END, 6) AS ndcg FROM s"""
)
def ndcg_at_k(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("source", "doc_id", "n_chars", (F.col("quality") * 2 + F.col("toxic")).alias("relevance"))
    return evaluate.ndcg(rows, 10, "source", "n_chars", "relevance", "doc_id").withColumn("ndcg", F.round("ndcg", 6))


# ---- look-ups and small steps


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def entities_by_keys(spark, sf):
    keys = table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return scans.by_keys(table(spark, sf, "customer").select("c_custkey", "c_name"), keys, ["c_custkey"])


@query("SELECT p_type AS entity_type, count(*) AS n FROM part WHERE lower(p_type) IN ('economy', 'promo') AND p_size > 5 GROUP BY p_type")
def type_scan(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("entity_type"), F.when(F.col("p_size") <= 5, F.lit("gone")).alias("deleted_at"))
    return scans.of_types(rows, ["Economy", "Promo"]).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source || '::' || doc_id AS qualified_name, doc_id AS entity_id, len(embedding) AS dimension FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id IN (SELECT doc_id FROM labels)")
def embeddings_by_name(spark, sf):
    name = F.concat(F.col("source"), F.lit("::"), F.col("doc_id").cast("string"))
    docs = table(spark, sf, "documents").select(name.alias("qualified_name"), F.col("doc_id").alias("entity_id"), F.col("doc_id").alias("embedding_id"), F.lit(None).alias("deleted_at"))
    names = docs.join(table(spark, sf, "labels").select(F.col("doc_id").alias("entity_id")), "entity_id", "left_semi").select("qualified_name")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return scans.embeddings_of_names(docs, vectors, names).select("qualified_name", "entity_id", F.size("embedding").cast("long").alias("dimension"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS field FROM events")
def payload_get(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("props").alias("payload"))
    return scans.payload_field(rows, "$.k", "long").select("event_id", "field")


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS INT) AS position FROM customer")
def sibling_positions(spark, sf):
    rows = table(spark, sf, "customer").select(F.lit("r").alias("repository_id"), F.col("c_nationkey").alias("parent_scope"), F.col("c_mktsegment").alias("entity_type"), F.col("c_acctbal").alias("start_line"), F.col("c_custkey").alias("entity_id"))
    return scans.sibling_index(rows).select(F.col("entity_id").alias("c_custkey"), "position")


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS simple, 'external::' || p_type || '::' || replace(p_name, ' ', '_') AS ext, p_type AS package FROM part")
def name_functions(spark, sf):
    target = F.concat(F.lit("crate::"), "p_type", F.lit("::"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("<"), "p_brand", F.lit(">"))
    return table(spark, sf, "part").select("p_partkey", X.simple_name(target).alias("simple"), X.external_name(target).alias("ext"), X.external_package(target).alias("package"))


@query("SELECT o_orderpriority, min(len_) AS shortest, max(len_) AS longest, avg(len_) AS mean FROM (SELECT o_orderpriority, length(o_orderstatus || o_orderkey) AS len_ FROM orders) GROUP BY o_orderpriority")
def length_stats(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", F.length(F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).alias("len_"))
    return rows.groupBy("o_orderpriority").agg(F.min("len_").cast("long").alias("shortest"), F.max("len_").cast("long").alias("longest"), F.avg("len_").alias("mean"))


@query("SELECT source, CAST(list_aggregate(list_sort(list(doc_id)), 'count') AS INT) AS n, min(doc_id) AS first FROM documents GROUP BY source")
def ids_by_file(spark, sf):
    rows = table(spark, sf, "documents").select(F.lit("r").alias("repository_id"), F.col("source").alias("file_path"), F.col("doc_id").alias("entity_id"))
    return ingest.ids_by_file(rows).select(F.col("file_path").alias("source"), F.size("entity_ids").alias("n"), F.get("entity_ids", F.lit(0)).alias("first"))


from codelode import queries_more  # noqa: E402, F401  (registers its queries here)
