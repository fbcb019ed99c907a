"""Query planner: signals of a query, the views there are and a budget choose a retrieval path made of DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import graph, lexical, ranking, vectors


@dataclass(frozen=True)
class Budget:
    """Candidates fetched by a branch, candidates reranked (0: none), and what may be used."""

    name: str
    candidates: int
    rerank: int
    allow_graph: bool
    prefer_rrf: bool
    allow_model: bool = False


# Candidates fetched and reranked under each budget, its other names, weights of fused branches.
BUDGETS = {
    "fast": Budget("fast", 32, 0, False, True),
    "balanced": Budget("balanced", 100, 50, True, True),
    "thorough": Budget("thorough", 128, 80, True, True, True),
}
ALIASES = {"cheap": "fast", "low": "fast", "default": "balanced", "quality": "thorough", "full": "thorough"}
WEIGHTS = {"dense": 0.6, "sparse": 0.4}


@dataclass(frozen=True)
class Expansion:
    """Seeds taken from the list, results kept, steps, and whether ranks come from a personalised walk."""

    seeds: int
    keep: int
    hops: int
    walk: bool


@dataclass(frozen=True)
class Plan:
    path: str
    branches: tuple[str, ...]
    fusion: str
    weights: dict = field(default_factory=dict)
    candidates: int = 100
    rerank: str | None = None
    rerank_candidates: int = 0
    expansion: Expansion | None = None


def budget(name: str = "balanced") -> Budget:
    key = (name or "balanced").strip().lower()
    try:
        return BUDGETS[ALIASES.get(key, key)]
    except KeyError:
        raise ValueError("unknown budget: choose fast, balanced or thorough") from None


def signals(query: str) -> tuple[bool, bool, bool]:
    """(lexical, semantic, structural) for one query; ``text.query_signals`` does the same for a column."""
    words = re.findall("[A-Za-z0-9_]+", query or "")
    structural = any(re.search(p, query, re.I) for p in text.STRUCTURAL)
    lexical = any(re.search(p, query) for p in text.LEXICAL)
    semantic = bool(re.search(text.SEMANTIC, query, re.I)) or len(words) >= 10
    return lexical or (not semantic and 0 < len(words) <= 4), semantic, structural


def select(query: str, views: set[str], budget_name: str | Budget = "balanced") -> Plan:
    """Graph for structural questions, one branch when cheap or one-sided, both fused when both kinds of evidence are there.

    ``views`` may name sparse, dense, graph, embeddings (for reranking) and model (a scorer for reranking).
    """
    b = budget_name if isinstance(budget_name, Budget) else budget(budget_name)
    lexical_, semantic, structural = signals(query)
    sparse, dense = "sparse" in views, "dense" in views
    strategy = "model" if b.allow_model and "model" in views else "embedding" if "embeddings" in views else None
    reranked = {"rerank": strategy, "rerank_candidates": b.rerank} if b.rerank and strategy else {}
    if structural and b.allow_graph and "graph" in views and sparse:
        more = Expansion(min(12, max(5, b.candidates // 12)), b.candidates, 1 if b.name == "fast" else 2, b.name == "thorough")
        return Plan("structural_graph", ("sparse",), "none", candidates=more.seeds, expansion=more, **reranked)
    if not (sparse or dense):
        raise ValueError("no view can answer the query")
    exact = Plan("fast_lexical", ("sparse",), "none", candidates=b.candidates)
    meaning = Plan("semantic", ("dense",), "none", candidates=b.candidates)
    if b.name == "fast":
        return exact if sparse and (lexical_ or not dense) else meaning
    if dense and (not sparse or (semantic and not lexical_)):
        return replace(meaning, **reranked)
    if dense:
        return Plan("hybrid_fusion", ("dense", "sparse"), "rrf" if b.prefer_rrf else "weighted", WEIGHTS, b.candidates, **reranked)
    return exact


def execute(
    plan: Plan, query: str, top_k: int, docs: DataFrame, vecs: DataFrame | None = None, query_vector: DataFrame | None = None, edges: DataFrame | None = None,
    vertices: DataFrame | None = None, scorer: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """(id, score) of the plan's result, best first. ``docs`` has id and content, ``vecs`` vec_id (the same ids) and embedding.

    Branches fetch ``plan.candidates``; several are fused. Expansion keeps the seeds first, then what it adds.
    The first ``rerank_candidates`` are reordered by their vector, or by ``scorer``: (rows, query) to (id, score);
    rows that it does not score follow in their order.
    """
    lists = []
    for branch in plan.branches:
        if branch == "sparse":
            hits = lexical.bm25(docs, "id", "content", re.findall("[a-z0-9]+", query.lower())).orderBy(F.desc("score"), "id").limit(plan.candidates)
        else:
            hits = vectors.search(vecs, query_vector, plan.candidates).select(F.col("vec_id").alias("id"), "score")
        lists.append(ranking.ranked(hits, F.desc("score"), "id", into="rank").select(F.lit(branch).alias("branch"), "rank", "id", "score"))
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    if len(lists) > 1:
        fused = ranking.fuse(rows.withColumn("content", F.lit(None).cast("string")), "id", plan.fusion, plan.weights).select("id", "score")
        rows = ranking.ranked(fused.orderBy(F.desc("score"), "id").limit(plan.candidates), F.desc("score"), "id", into="rank")
    rows = rows.select("id", "rank", "score")
    if plan.expansion:
        rows = _expanded(rows, plan.expansion, edges, vertices)
    if plan.rerank:
        rows = _reranked(rows, plan, query, docs, vecs, query_vector, scorer)
    return rows.orderBy("rank").limit(top_k).select("id", "score")


def _expanded(rows: DataFrame, more: Expansion, edges: DataFrame, vertices: DataFrame | None) -> DataFrame:
    seeds = rows.filter(F.col("rank") <= more.seeds).select(F.col("id").alias("vid"), F.col("rank").cast("long").alias("rank"), "score")
    if more.walk:
        walked = graph.personalized_pagerank(edges, seeds, 10)
        near = walked.join(seeds, "vid", "left_anti").select("vid", (-F.col("rank")).alias("place"), F.col("rank").alias("score"))
    else:
        near = graph.bfs(edges, seeds, more.hops, "both").filter("depth > 0").select("vid", F.col("depth").cast("double").alias("place"), (1.0 / (F.col("depth") + 1)).alias("score"))
    if vertices is not None:
        near = near.join(vertices.select("vid"), "vid", "left_semi")
    near = near.orderBy("place", "vid").limit(more.keep)
    every = seeds.select("vid", F.lit(0).alias("tier"), F.col("rank").cast("double").alias("place"), "score").unionByName(near.select("vid", F.lit(1).alias("tier"), "place", "score"))
    return ranking.ranked(every.orderBy("tier", "place", "vid").limit(more.keep), "tier", "place", "vid", into="rank").select(F.col("vid").alias("id"), "rank", "score")


def _reranked(rows: DataFrame, plan: Plan, query: str, docs: DataFrame, vecs: DataFrame | None, query_vector: DataFrame | None, scorer) -> DataFrame:
    head = rows.filter(F.col("rank") <= plan.rerank_candidates)
    if plan.rerank == "model":
        if scorer is None:
            raise ValueError("the plan reranks by a model: give a scorer")
        scored = scorer(head.join(docs, "id").select("id", "content"), query)
    else:
        q = query_vector.select(F.col("embedding").alias("__q")).limit(1)
        scored = vecs.withColumnRenamed("vec_id", "id").join(head.select("id"), "id", "left_semi").crossJoin(F.broadcast(q)).select("id", vectors.dot("embedding", "__q").alias("score"))
    own = head.select("id", "rank", F.col("score").alias("__first")).join(scored.select("id", F.col("score").alias("__again")), "id", "left")
    order = [F.desc(F.col("__again").isNotNull()), F.desc("__again"), F.col("rank")]
    again = own.withColumn("place", F.row_number().over(W.orderBy(*order))).select("id", F.col("place").alias("rank"), F.coalesce("__again", "__first").alias("score"))
    return again.unionByName(rows.filter(F.col("rank") > plan.rerank_candidates))


def dense_graph_search(vecs: DataFrame, query_vector: DataFrame, edges: DataFrame, vertices: DataFrame, top_k: int, seeds: int = 20, per_seed: int = 5, keep=None, types: tuple = ("reference",), by_file: bool = False) -> DataFrame:
    """Dense seeds and their neighbours, filtered, each vertex once, reranked by vector: (id, score), or (file, score) fused by file.

    ``vertices`` has vid, name and file; ``keep`` is a condition on them. Neighbours without a vector follow those with one.
    """
    hits = vectors.search(vecs, query_vector, seeds).select(F.col("vec_id").alias("vid"), "score")
    first = ranking.ranked(hits, F.desc("score"), "vid", into="rank").select("vid", F.col("rank").cast("long").alias("rank"), "score")
    near = graph.expand_one_hop(first, edges, vertices, per_seed, types).select("vid", F.lit(1).alias("tier"), (F.col("seed_rank") * 1000 + F.col("n")).cast("long").alias("place"), "score")
    every = first.select("vid", F.lit(0).alias("tier"), F.col("rank").alias("place"), "score").unionByName(near)
    once = every.groupBy("vid").agg(F.min_by(F.struct("tier", "place", "score"), F.struct("tier", "place")).alias("r")).join(vertices.select("vid", "file"), "vid")
    once = once.filter(keep) if keep is not None else once
    listed = ranking.ranked(once.select("vid", "file", "r.*"), "tier", "place", "vid", into="rank")
    q = query_vector.select(F.col("embedding").alias("__q")).limit(1)
    again = vecs.select(F.col("vec_id").alias("vid"), "embedding").join(listed.select("vid"), "vid", "left_semi").crossJoin(F.broadcast(q)).select("vid", vectors.dot("embedding", "__q").alias("again"))
    order = [F.desc(F.col("again").isNotNull()), F.desc("again"), F.col("rank")]
    rows = listed.join(again, "vid", "left").withColumn("place", F.row_number().over(W.orderBy(*order)))
    if by_file:
        best = rows.select(F.lit("dense").alias("branch"), F.col("place").alias("rank"), F.col("vid").alias("node_id"), "file", "score", F.lit(None).cast("string").alias("content"))
        return ranking.fuse_by_file(best).select("file", "score").orderBy(F.desc("score"), "file").limit(top_k)
    return rows.orderBy("place").limit(top_k).select(F.col("vid").alias("id"), F.coalesce("again", "score").alias("score"))
