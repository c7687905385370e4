"""Iterative search: a planner chooses searches and graph steps until nothing new is found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import is_simple_lookup, prompt_entry
from codelode.operators.ingest import keep_first

ITERATIONS, DIRECT_WITH_GRAPH, DIRECT_ALONE, MOST_QUERY = 5, 5, 10, 10_000


@dataclass
class Step:
    """What to do in one iteration: texts to search, graph queries as (kind, name); stop ends the search."""

    searches: list[str] = field(default_factory=list)
    graph: list[tuple[str, str]] = field(default_factory=list)
    stop: bool = False


class Planner(Protocol):
    def plan(self, query: str, iteration: int, found: list[str]) -> Step: ...


class RulePlanner:
    """Deterministic: search first; then, for words of relation in the question, one graph step on the best hits."""

    KINDS = {"call": "callers", "use": "callers", "implement": "implementations", "inherit": "hierarchy", "extend": "hierarchy", "contain": "contents", "import": "dependencies", "depend": "dependencies"}

    def plan(self, query: str, iteration: int, found: list[str]) -> Step:
        if iteration == 1:
            return Step(searches=[query])
        kinds = dict.fromkeys(kind for word, kind in self.KINDS.items() if word in query.lower())
        return Step(graph=[(k, name) for k in kinds for name in found[:DIRECT_WITH_GRAPH]]) if iteration == 2 and kinds else Step(stop=True)


def combine(direct: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """Direct hits, then what the graph added, each key once (key, origin)."""
    both = direct.select(key, F.lit("direct").alias("origin"), F.lit(0).alias("__o")).union(graph.select(key, F.lit("graph").alias("origin"), F.lit(1).alias("__o")))
    return keep_first(both, [key], "__o").drop("__o")


def prompt(results: DataFrame, limit: int) -> str:
    """The best results as text for a planner (entity_id, entity_type, qualified_name, source, origin, relation, score, content), best first."""
    entry = prompt_entry(*[F.col(c) for c in ("entity_id", "entity_type", "qualified_name", "source", "origin", "relation", "score", "content")])
    rows = results.orderBy(F.desc_nulls_last("score"), "entity_id").limit(limit).select(entry.alias("entry")).collect()
    return "\n\n---\n\n".join(r.entry for r in rows)


def run(query: str, search: Callable[[str, int], DataFrame], walk: Callable[[str, str], DataFrame], planner: Planner | None = None, key: str = "qualified_name") -> list[tuple[str, str]]:
    """(key, origin) of the results.  search(text, limit) and walk(kind, name) give tables with a column `key`.

    Only the bounded lists of result names are held on the driver between iterations."""
    if not 1 <= len(query) <= MOST_QUERY:
        raise ValueError("a query has 1 to 10000 characters")
    planner = planner or RulePlanner()
    direct: dict[str, None] = {}
    graph: dict[str, None] = {}
    for iteration in range(1, (1 if is_simple_lookup(query) else ITERATIONS) + 1):
        step = planner.plan(query, iteration, [*direct, *graph])
        if step.stop or not (step.searches or step.graph):
            break
        before = len(direct) + len(graph)
        for text in step.searches:
            direct.update(dict.fromkeys(r[0] for r in search(text, DIRECT_ALONE).select(key).collect()))
        for kind, name in step.graph:
            rows = walk(kind, name).select(key).distinct().orderBy(key).limit(1000).collect()
            graph.update(dict.fromkeys(r[0] for r in rows if r[0] not in direct))
        if len(direct) + len(graph) == before and iteration > 1:
            break
    best = list(direct)[: DIRECT_WITH_GRAPH if graph else DIRECT_ALONE]
    return [(x, "direct") for x in best] + [(x, "graph") for x in graph]
