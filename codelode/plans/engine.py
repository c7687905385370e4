"""The engine: tables in, search, graph, iterative and indexing operations out; every result is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.functions.embedding import Provider, embed, for_task, hashing_provider, word_overlap
from codelode.operators import graph, ingest, resolve, retrieval
from codelode.operators.extract import extract_table
from codelode.plans import agentic


@dataclass
class Filters:
    entity_types: list[str] | None = None
    language: str | None = None
    file_path: str | None = None
    implements_trait: str | None = None
    in_module: str | None = None
    calls: str | None = None
    called_by: str | None = None


@dataclass
class SearchRequest:
    """A search; embedding, if given, takes the place of the embedded text."""

    query: str
    limit: int = 10
    prefetch_multiplier: int = 5
    repositories: list[str] | None = None
    filters: Filters = field(default_factory=Filters)
    embedding: list[float] | None = None
    rerank: bool = False
    rerank_candidates: int = 100
    prefilter: bool = True


GRAPH = {"callers": graph.callers, "callees": graph.callees, "implementations": graph.implementations, "hierarchy": graph.hierarchy, "contents": graph.contents, "dependencies": graph.dependencies, "unused": graph.unused, "cycles": graph.cycles}
RESULT = ["repository_id", "entity_id", "name", "qualified_name", "entity_type", "language", "file_path", "content"]


@dataclass
class Engine:
    """entities: live and deleted entity rows with a column `embedding`; edges: typed edges."""

    spark: SparkSession
    entities: DataFrame
    edges: DataFrame
    provider: Provider = field(default_factory=hashing_provider)
    reranker: Callable[[str], Callable[[Column], Column]] = word_overlap

    def repositories(self) -> DataFrame:
        return ingest.live(self.entities).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_entities"))

    def get(self, keys: list[tuple[str, str]]) -> DataFrame:
        """Live entities of (repository_id, entity_id) keys."""
        wanted = self.spark.createDataFrame(keys, "repository_id string, entity_id string").distinct()
        return ingest.live(self.entities).join(F.broadcast(wanted), ["repository_id", "entity_id"], "left_semi").select(*RESULT)

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return self.provider(texts)

    def nodes(self, repository: str | None = None) -> DataFrame:
        rows = ingest.live(self.entities)
        rows = rows if repository is None else rows.filter(F.col("repository_id") == repository)
        return rows.select(F.col("entity_id").alias("id"), "name", "qualified_name", F.col("entity_type").alias("kind"), "visibility")

    def graph_query(self, kind: str, name: str | None = None, repository: str | None = None, limit: int | None = None, semantic: str | None = None, **more) -> DataFrame:
        """One of the fixed graph queries, within one repository if given; semantic keeps the best by the reranker."""
        edges = self.edges if repository is None else self.edges.filter(F.col("repository_id") == repository)
        args = [name] if name is not None else []
        found = GRAPH[kind](edges, self.nodes(repository), *args, **more)
        if semantic and "qualified_name" in found.columns:
            content = ingest.live(self.entities).select("qualified_name", F.coalesce("content", "qualified_name").alias("__c"))
            found = found.join(content, "qualified_name").withColumn("score", self.reranker(semantic)(F.col("__c"))).drop("__c")
            return retrieval.top(found, limit or 10, "score", "qualified_name")
        return found if limit is None else found.limit(retrieval.clamp(limit, 1, 1000))

    def structural_sets(self, f: Filters, repository: str) -> list[DataFrame]:
        out = []
        if f.implements_trait:
            out.append(self.graph_query("implementations", f.implements_trait, repository).select(F.col("type_name").alias("name")))
        if f.in_module:
            out.append(self.graph_query("contents", f.in_module, repository))
        if f.calls:
            out.append(self.graph_query("callers", f.calls, repository))
        if f.called_by:
            out.append(self.graph_query("callees", f.called_by, repository))
        return out

    def search(self, r: SearchRequest) -> DataFrame:
        """Hybrid search: filters before both lists, fusion within each repository, merging, optional reranking.

        All repositories are ranked in one pass; only structural conditions, which ask each repository's graph, are
        taken one repository at a time."""
        limit = retrieval.clamp(r.limit, 1, 1000)
        n = retrieval.prefetch(limit, r.prefetch_multiplier)
        rows = retrieval.metadata_filter(ingest.live(self.entities), r.filters.entity_types, r.filters.language, r.filters.file_path)
        if r.repositories:
            rows = rows.filter(F.col("repository_id").isin(r.repositories))
        allowed = self._allowed(rows, r) if any([r.filters.implements_trait, r.filters.in_module, r.filters.calls, r.filters.called_by]) else None
        keys = ["repository_id", "entity_id"]
        own = rows.join(allowed, keys, "left_semi") if allowed is not None and r.prefilter else rows
        vector = r.embedding or for_task(self.provider, "query")([r.query])[0]
        lists = [retrieval.bm25_by_group(own, r.query, n, "entity_id", "content", "repository_id"), retrieval.dense_by_group(own, vector, n, "entity_id", "embedding", "repository_id")]
        best = retrieval.fuse_by_group(lists, limit, "entity_id", "repository_id")
        if allowed is not None and not r.prefilter:
            best = best.join(allowed, keys, "left_semi")
        kept = min(r.rerank_candidates, 1000) if r.rerank else limit
        found = retrieval.top(best, kept, "score", "entity_id").join(ingest.live(self.entities).select(*RESULT), keys)
        if r.rerank:
            found = found.withColumn("score", self.reranker(r.query)(X.truncate_utf8(F.coalesce("content", "name"))))
        return retrieval.top(found, limit, "score", "entity_id")

    def _allowed(self, rows: DataFrame, r: SearchRequest) -> DataFrame:
        """Keys of the rows that meet the structural conditions of their own repository."""
        names = r.repositories or [x[0] for x in rows.select("repository_id").distinct().orderBy("repository_id").collect()]
        keys = rows.select("repository_id", "entity_id", "name", "qualified_name")
        parts = [self._within(keys.filter(F.col("repository_id") == name), self.structural_sets(r.filters, name)).select("repository_id", "entity_id") for name in names]
        return reduce(DataFrame.union, parts) if parts else keys.select("repository_id", "entity_id").limit(0)

    def cache_statistics(self, cache: DataFrame) -> DataFrame:
        return ingest.cache_stats(cache)

    def clear_cache(self, cache: DataFrame, model: str | None = None) -> DataFrame:
        """The embedding cache without one model's rows, or empty."""
        return ingest.purge(cache, "model_version", [model] if model else [])

    def drop(self, repository: str) -> Engine:
        """An engine without a repository's entities and edges."""
        return replace(self, entities=ingest.purge(self.entities, "repository_id", [repository]), edges=ingest.purge(self.edges, "repository_id", [repository]))

    @staticmethod
    def _within(rows: DataFrame, sets: list[DataFrame]) -> DataFrame:
        for s in sets:
            key = "name" if "name" in s.columns else "qualified_name"
            rows = rows.join(s.select(key).distinct(), key, "left_semi")
        return rows

    def agentic(self, query: str, planner: agentic.Planner | None = None) -> list[tuple[str, str]]:
        def walk(kind: str, name: str) -> DataFrame:
            found = self.graph_query(kind, name)
            if "qualified_name" not in found.columns:
                column = F.explode("path") if kind == "hierarchy" else F.col("type_name")
                found = found.select(column.alias("qualified_name"))
            return found

        return agentic.run(query, lambda text, n: self.search(SearchRequest(text, n)), walk, planner)


def index(files: DataFrame, cache: DataFrame | None, provider: Provider, model: str) -> tuple[DataFrame, DataFrame]:
    """(entity rows with embedding, new cache rows): extract, hash the embedding text, embed only what the cache lacks.

    cache: repository_id, model_version, content_hash, embedding.  Equal texts are embedded once."""
    rows = ingest.keep_last(extract_table(files), ["repository_id", "file_path", "qualified_name", "entity_type"], "start_line", "end_line")
    none = F.lit(None).cast("string")
    text = X.sanitize(X.embedding_text(F.col("entity_type"), F.col("name"), F.col("qualified_name"), F.col("documentation_summary"), F.lit(None).cast("array<struct<name:string,type:string>>"), none, F.col("content")))
    rows = rows.withColumns({"__text": text, "content_hash": X.xxh3_hex(text), "model_version": F.lit(model), "bm25_token_count": X.token_count(F.col("content"))})
    rows = rows.withColumn("entity_id", X.entity_id(F.col("repository_id"), F.col("file_path"), F.col("qualified_name"), F.col("entity_type")))
    keys = ["repository_id", "model_version", "content_hash"]
    wanted = rows.select(*keys, "__text").dropDuplicates(keys)
    hits = cache.select(*keys, "embedding") if cache is not None else None
    misses = wanted if hits is None else wanted.join(hits.select(*keys), keys, "left_anti")
    new = embed(misses, "__text", provider).select(*keys, "embedding").filter("embedding IS NOT NULL")
    known = new if hits is None else hits.unionByName(new)
    return rows.join(known, keys).drop("__text"), new


def build_edges(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, external nodes) of a repository's entities: containment and the resolved references."""
    found, outside = resolve.resolve(entities)
    return reduce(DataFrame.union, [resolve.contains_edges(entities), found.select("repository_id", "src", "dst", "rel_type")]).dropDuplicates(), outside
