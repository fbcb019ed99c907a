"""Navigation over code views: names, definitions, references, routes, excerpts, expansion, drafting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import graph


def resolve_names(wanted: DataFrame, vertices: DataFrame) -> DataFrame:
    """(wanted, vid, how) where a name means one vertex: exact, else with or without call brackets, else as the last part.

    Several vertices at the first level that has any: vid is null, ``matches`` tells how many.
    """
    bare = lambda c: F.regexp_replace(c, r"\(\)$", "")
    leaf = lambda c: F.regexp_extract(bare(c), r"([^.:#/]+)$", 1)
    v = vertices.select("vid", "name", bare(F.col("name")).alias("b"), leaf(F.col("name")).alias("l"))
    w = wanted.select("wanted").distinct()
    exact = w.join(v, F.col("wanted") == F.col("name")).select("wanted", "vid", F.lit(0).alias("level"))
    near = w.join(v, bare(F.col("wanted")) == F.col("b")).select("wanted", "vid", F.lit(1).alias("level"))
    last = w.join(v, bare(F.col("wanted")) == F.col("l")).select("wanted", "vid", F.lit(2).alias("level"))
    hits = exact.unionByName(near).unionByName(last).groupBy("wanted", "level").agg(F.count_distinct("vid").alias("matches"), F.min("vid").alias("vid"))
    best = hits.groupBy("wanted").agg(F.min_by(F.struct("level", "matches", "vid"), "level").alias("m"))
    return w.join(best, "wanted", "left").select("wanted", F.when(F.col("m.matches") == 1, F.col("m.vid")).alias("vid"), F.coalesce("m.matches", F.lit(0)).cast("long").alias("matches"))


def definition_at(points: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Targets of the edges anchored where a point is, in edge order: (key, vid, n)."""
    hits = points.join(anchors.select(F.col("anchor_file").alias("file"), F.col("anchor_line").alias("line"), "dst", "eid"), ["file", "line"])
    once = hits.groupBy(key, F.col("dst").alias("vid")).agg(F.min("eid").alias("eid"))
    return once.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("eid", "vid"))).drop("eid")


def references(targets: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Distinct places that refer to each target, in order, at most ``limit``."""
    hits = edges.filter(F.col("anchor_line").isNotNull()).join(targets.select(F.col("vid").alias("dst")), "dst").select(F.col("dst").alias("vid"), "anchor_file", "anchor_line").distinct()
    return hits.withColumn("n", F.row_number().over(W.partitionBy("vid").orderBy("anchor_file", "anchor_line"))).filter(F.col("n") <= limit)


# Terms that a route query may mean by its own, and the bonus of each role.
ROUTE_SYNONYMS = {
    "cached": ["cache"], "caching": ["cache"], "directory": ["dir", "location", "path"], "directories": ["dir", "location", "path"], "fetch": ["download", "retrieve"], "fetches": ["download", "retrieve"], "fetching": ["download", "retrieve"],
    "location": ["path"], "locations": ["path"], "placeholder": ["replace", "replacer", "replacement", "template"], "placeholders": ["replace", "replacer", "replacement", "template"], "property": ["provider", "value"], "properties": ["provider", "value"],
    "retrieval": ["retrieve", "download", "cache"], "retrieve": ["download", "cache"], "retrieves": ["download", "cache"], "retrieving": ["download", "cache"], "resolution": ["resolve", "resolver", "replace", "replacer"], "resolved": ["resolve", "resolver", "replace", "replacer"],
    "substitution": ["replace", "replacer", "replacement"], "substitute": ["replace", "replacer", "replacement"], "token": ["replace", "replacer", "replacement", "template"], "tokens": ["replace", "replacer", "replacement", "template"],
    "variable": ["replace", "replacer", "replacement"], "variables": ["replace", "replacer", "replacement"],
}
ROLE_BONUS = {"endpoint": 4.0, "bridge": 3.0, "provider": 2.0, "type": 1.0}


def route_terms(query: list[str]) -> list[str]:
    """A query's terms with those that they may mean."""
    return sorted({*query, *(x for t in query for x in ROUTE_SYNONYMS.get(t, []))})


def route_scores(nodes: DataFrame, query_terms: list[str], name: str = "name", rank: str = "rank") -> DataFrame:
    """Route order of nodes (name, type, start_line, end_line, and the rank of a direct seed, from 0, or null).

    Five for each term shared with the query or its synonyms, 8 less the rank for a seed and 3 for what was
    found around seeds, and the role's bonus.
    """
    terms, query = text.subword_terms(F.col(name)), F.array(*[F.lit(t) for t in route_terms(query_terms)])
    leaf = F.regexp_extract(F.regexp_replace(F.col(name), r"\(.*$", ""), r"([^.:]*)$", 1)
    lines = F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    own = nodes.withColumn("role", graph.roles(terms, query, F.col("type"), leaf, lines)).withColumn("shared", F.size(F.array_intersect(terms, query)))
    bonus = F.lit(0.0)
    for role, value in ROLE_BONUS.items():
        bonus = F.when(F.col("role") == role, value).otherwise(bonus)
    return own.withColumn("score", 5.0 * F.col("shared") + F.when(F.col(rank).isNotNull(), F.greatest(F.lit(0), 8 - F.col(rank))).otherwise(3) + bonus)


def expand_candidates(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, limit: int, hops: int = 2) -> DataFrame:
    """Seeds (vid, rank, score), then what a breadth-first region adds (one hop if it adds nothing), each vertex once."""
    near = graph.bfs(edges, seeds.select("vid"), hops, "both").filter("depth > 0")
    added = near.join(vertices.select("vid", "name"), "vid").select("vid", F.lit(1).alias("tier"), F.col("depth").cast("long").alias("place"))
    rows = seeds.select("vid", F.lit(0).alias("tier"), F.col("rank").cast("long").alias("place")).unionByName(added)
    once = rows.groupBy("vid").agg(F.min(F.struct("tier", "place")).alias("at"))
    return once.orderBy("at.tier", "at.place", "vid").limit(limit).select("vid", F.col("at.tier").cast("long").alias("tier"), F.col("at.place").alias("place"))


def default_seed(vertices: DataFrame, entry: DataFrame, names: list[str]) -> DataFrame:
    """Vertices in the order of their entry affinity (the place of their name in ``names``), out-degree and name."""
    affinity = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower("name"))
    own = vertices.join(entry, "vid", "left").withColumn("affinity", F.when(affinity > 0, 2 * (affinity - 1)).otherwise(2 * len(names)).cast("long"))
    return own.orderBy("affinity", F.desc(F.coalesce("entry", F.lit(0.0))), "name", "vid")


def hierarchy_view(nodes: DataFrame, cap: int) -> DataFrame:
    """Degree of interest (importance less 0.12 a reference step and 0.04 a tree step), the ``cap`` best of each parent."""
    doi = F.col("importance") - 0.12 * F.col("ref_distance") - 0.04 * F.col("tree_distance")
    own = nodes.withColumn("doi", F.bround(doi, 6))
    return own.withColumn("n", F.row_number().over(W.partitionBy("parent").orderBy(F.desc("doi"), "id"))).filter(F.col("n") <= cap)


def merge_anchors(anchors: DataFrame, pad: int, gap: int, longest: int) -> DataFrame:
    """Source windows around anchors (query, file, s, e, rank): padded, merged while the gap is small and the window not too long."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values(["file", "s", "e"]).itertuples(index=False):
            s, e = max(0, r.s - pad), r.e + pad
            if out and out[-1][1] == r.file and s <= out[-1][3] + gap + 1 and max(e, out[-1][3]) - out[-1][2] + 1 <= longest:
                out[-1][3], out[-1][4] = max(e, out[-1][3]), min(r.rank, out[-1][4])
            else:
                out.append([r.query, r.file, s, e, r.rank])
        return pd.DataFrame(out, columns=["query", "file", "s", "e", "rank"])

    return anchors.select("query", "file", "s", "e", "rank").groupBy("query").applyInPandas(run, "query string, file string, s long, e long, rank long")


def excerpt(rows: DataFrame, content: str, terms: Column, limit: int, head: int = 5, around: int = 2) -> DataFrame:
    """A bounded excerpt: the first lines, then windows around the lines that share most terms, in line order."""

    def run(batches):
        for contents, wanted in batches:
            out = []
            for body, words in zip(contents, wanted):
                if body is None or len(body) <= limit:
                    out.append(body)
                    continue
                lines = body.split("\n")
                kept = set(range(min(head, len(lines))))
                scored = sorted(((-sum(w in line.lower() for w in words), i) for i, line in enumerate(lines)), key=lambda x: x)
                size = sum(len(lines[i]) + 1 for i in kept)
                for minus, i in scored:
                    more = set(range(max(0, i - around), min(len(lines), i + around + 1))) - kept
                    extra = sum(len(lines[j]) + 1 for j in more)
                    if minus == 0 or size + extra > limit:
                        continue
                    kept |= more
                    size += extra
                out.append("\n".join(lines[i] for i in sorted(kept))[:limit])
            yield pd.Series(out, dtype=object)

    return rows.withColumn("excerpt", F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(content), terms))


def continuations(sequences: DataFrame, key: str, tokens: str, length: int) -> DataFrame:
    """Draft table: after each run of ``length`` tokens, the token that follows most often (ties: the smaller), with its count."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), n - length), lambda i: F.struct(F.slice(tokens, i, F.lit(length)).alias("prefix"), F.get(F.col(tokens), i + length - 1).alias("next")))
    rows = sequences.filter(n > length).select(F.explode(runs).alias("r")).select(F.array_join("r.prefix", " ").alias("prefix"), "r.next")
    counted = rows.groupBy("prefix", "next").agg(F.count("*").alias("times"))
    return counted.groupBy("prefix").agg(F.min_by(F.struct("next", "times"), F.struct((-F.col("times")).alias("t"), "next")).alias("b")).select("prefix", "b.next", "b.times")


def answer_neighbours(answers: DataFrame, vertices: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """Neighbours, either way, of answered vertices (file, name): distinct, at most ``cap`` each."""
    first = vertices.groupBy("file", "name").agg(F.min("vid").alias("vid"))
    own = answers.join(first, ["file", "name"]).select(F.col("vid").alias("from"))
    hits = graph.both_ways(edges).select("from", "to").distinct().join(own, "from")
    return hits.withColumn("n", F.row_number().over(W.partitionBy("from").orderBy("to"))).filter(F.col("n") <= cap)


def trial_summary(trials: DataFrame, by: list[str], arm: str, arms: list[str]) -> DataFrame:
    """Means over valid trials, counts over all, the spread, and the newest, side by side for each arm."""
    return trials.groupBy(*by).pivot(arm, arms).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("valid"), F.col("value"))).alias("mean"), F.stddev_pop(F.when(F.col("valid"), F.col("value"))).alias("std"), F.max_by("value", "created").alias("newest"))
