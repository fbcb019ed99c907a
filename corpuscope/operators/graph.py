"""Property graph over ``vertices`` (vid, name, type, file, start_line, end_line, ...) and ``edges`` (eid, src, dst, type, anchor_file, anchor_line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.session import checkpoint

# Edge types of each layer; an edge may be in several.
LAYERS = {
    "containment": ["contain"],
    "dependency": ["reference", "import", "type-use"],
    "reference": ["reference"],
    "import": ["import"],
    "type-use": ["type-use"],
}
EDGE_KEY = ["src", "dst", "type", "anchor_file", "anchor_line"]


def upsert_vertices(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One vertex a name: later attributes overwrite."""
    return rows.groupBy("name").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "name"]), order).alias("v")).select("name", "v.*")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Edge identity is (src, dst, type, anchor); the first written stays."""
    return edges.groupBy(*EDGE_KEY).agg(F.min("eid").alias("eid"))


def merge_vertices(shards: DataFrame) -> DataFrame:
    """Vertices of several shards by name; one without a definition cannot replace one that has it."""
    last = F.struct(F.coalesce("has_definition", F.lit(False)).alias("d"), "shard")
    return shards.groupBy("name").agg(F.max_by(F.struct(*[c for c in shards.columns if c != "name"]), last).alias("v")).select("name", "v.*")


def in_layer(layer: str) -> Column:
    return F.lit(True) if layer == "all" else F.col("type").isin(LAYERS[layer])


def layer_summary(edges: DataFrame) -> DataFrame:
    """Edges and distinct nodes of each layer that has any, ``all`` included. One row a node meets, whatever its layers."""
    names = ["all", *LAYERS]
    bits = F.lit(1)
    for i, types in enumerate(LAYERS.values(), 1):
        bits = bits.bitwiseOR(F.when(F.col("type").isin(types), 1 << i).otherwise(0))
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("one")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("one")))).alias("e"), bits.alias("bits"))
    has = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    nodes = ends.groupBy("e.vid").agg(F.bit_or("bits").alias("of"), *[F.sum(F.when(has("bits", i), F.col("e.one")).otherwise(0)).alias(f"edges_{i}") for i in range(len(names))])
    total = nodes.agg(*[x for i in range(len(names)) for x in (F.sum(f"edges_{i}").alias(f"edges_{i}"), F.count_if(has("of", i) & F.col("vid").isNotNull()).alias(f"nodes_{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(f"edges_{i}").alias("edges"), F.col(f"nodes_{i}").alias("nodes")) for i, x in enumerate(names)]))
    return total.select(rows.alias("r")).select("r.*").filter("edges > 0")


def both_ways(edges: DataFrame) -> DataFrame:
    """(from, to, eid, way): out is 0, in is 1."""
    out = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "eid", "type", F.lit(0).alias("way"))
    return out.unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "eid", "type", F.lit(1).alias("way")))


def adjacent(edges: DataFrame, direction: str) -> DataFrame:
    rows = both_ways(edges)
    return rows if direction == "both" else rows.filter(f"way = {0 if direction == 'out' else 1}")


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(vid, to, eid): distinct neighbours of each seed, in the order of their first edge."""
    own = edges.filter(F.col("type").isin(types)) if types else edges
    hits = adjacent(own, direction).join(seeds.select(F.col("vid").alias("from")), "from")
    return hits.groupBy(F.col("from").alias("vid"), "to").agg(F.min("eid").alias("eid"))


def expand_one_hop(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, per_seed: int = 5, types=("reference",), decay: float = 0.5, direction: str = "both") -> DataFrame:
    """Neighbours of ranked seeds (vid, rank, score), successors and predecessors in turn, at most ``per_seed`` each."""
    rows = adjacent(edges.filter(F.col("type").isin(list(types))), direction).groupBy("from", "to", "way").agg(F.min("eid").alias("eid"))
    hits = rows.join(seeds.select(F.col("vid").alias("from"), F.col("rank").alias("seed_rank"), F.col("score").alias("seed_score")), "from")
    hits = hits.withColumn("turn", F.row_number().over(W.partitionBy("from", "way").orderBy("eid", "to")))
    once = hits.groupBy("from", "seed_rank", "seed_score", "to").agg(F.min(F.struct("turn", "way")).alias("at"))
    kept = once.withColumn("n", F.row_number().over(W.partitionBy("from").orderBy("at.turn", "at.way"))).filter(F.col("n") <= per_seed)
    score = F.when(F.col("seed_score").isNull(), 1.0 / F.col("seed_rank")).otherwise(F.col("seed_score") * decay)
    kept = kept.join(vertices.select(F.col("vid").alias("to"), "name"), "to")
    return kept.select(F.col("from").alias("seed"), "seed_rank", F.col("to").alias("vid"), "name", "n", score.alias("score"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(vid, depth): least distance from any seed, to ``depth``. One frontier join a level."""
    ends = edges.select("src", "dst")
    ends = checkpoint(ends) if depth > 1 else ends  # joined once a level, where what is reached is made distinct
    ways = {"out": [("src", "dst")], "in": [("dst", "src")]}.get(direction, [("src", "dst"), ("dst", "src")])
    steps = reduce(DataFrame.unionByName, [ends.select(F.col(a).alias("from"), F.col(b).alias("to")) for a, b in ways])
    seen = checkpoint(seeds.select("vid").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(steps, frontier["vid"] == steps["from"]).select(F.col("to").alias("vid")).distinct()
        frontier = checkpoint(reached.join(seen, "vid", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def dependency_subgraph(edges: DataFrame, seeds: DataFrame, depth: int, direction: str, max_nodes: int, max_edges: int) -> DataFrame:
    """Bounded neighbourhood: nodes by (depth, vid) up to ``max_nodes``, the edges among them by eid up to ``max_edges``."""
    own = edges.filter(in_layer("reference"))
    near = bfs(own, seeds, depth, direction).orderBy("depth", "vid").limit(max_nodes)
    inside = own.join(near.select(F.col("vid").alias("src")), "src", "left_semi").join(near.select(F.col("vid").alias("dst")), "dst", "left_semi")
    return inside.orderBy("eid").limit(max_edges).select("eid", "src", "dst", "type")


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int = 8) -> DataFrame:
    """(step, vid) along a shortest outgoing path over all edge types; of equal ones, the smallest parent at each step."""
    return _path(checkpoint(edges.select("src", "dst")), source, target, max_depth)


def _path(steps: DataFrame, source: int, target: int, max_depth: int) -> DataFrame:
    """As ``shortest_path``, over steps (src, dst) that are read once a level."""
    spark = steps.sparkSession
    seen = checkpoint(spark.range(1).select(F.lit(source).cast("long").alias("vid"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")))
    frontier = seen
    for d in range(1, max_depth + 1):
        if seen.filter(F.col("vid") == target).limit(1).count():
            break
        reached = frontier.join(steps, frontier["vid"] == steps["src"]).groupBy(F.col("dst").alias("vid")).agg(F.min("vid").alias("parent"))
        frontier = checkpoint(reached.join(seen, "vid", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    path, vid = [], target
    while (row := seen.filter(F.col("vid") == vid).first()) is not None:  # at most max_depth + 1 lookups
        path.append((row.depth, row.vid))
        if row.parent is None:
            break
        vid = row.parent
    return spark.createDataFrame(sorted(path), "step int, vid long")


def distance(edges: DataFrame, a: int, b: int, max_depth: int = 8) -> int:
    """The lesser of the directed distances, or -1."""
    found = [shortest_path(edges, x, y, max_depth).count() - 1 for x, y in ((a, b), (b, a))]
    return min((n for n in found if n >= 0), default=-1)


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(vid, rank): power iteration with restarts on the seeds; parallel edges weigh; mass that finds no way out restarts."""
    links = checkpoint(edges.groupBy("src", "dst").agg(F.count("*").alias("w")))
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    flow = checkpoint(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    start = seeds.select("vid").distinct()
    n = start.count()
    reset = start.withColumn("reset", F.lit(1.0 / max(n, 1)))
    rank = reset.select("vid", F.col("reset").alias("rank"))
    for i in range(rounds):
        moved = rank.join(flow, rank["vid"] == flow["src"]).groupBy(F.col("dst").alias("vid")).agg(F.sum(F.col("rank") * F.col("share")).alias("m"))
        kept = moved.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("kept"))
        rank = moved.join(reset, "vid", "full_outer").crossJoin(F.broadcast(kept)).select(
            "vid", (damping * F.coalesce("m", F.lit(0.0)) + F.coalesce("reset", F.lit(0.0)) * (1 - damping + damping * (1 - F.col("kept")))).alias("rank")
        )
        rank = checkpoint(rank) if i % 3 == 2 or i == rounds - 1 else rank
    return rank


def range_query(spans: DataFrame, anchors: DataFrame, file, start: int, end: int) -> DataFrame:
    """Nodes defined in a range, edges anchored in it, and edges from elsewhere to those nodes: (role, id)."""
    hit = (F.col("file") == file) & (F.col("start_line") <= end) & (F.col("end_line") >= start)
    defined = spans.filter(hit).select("vid")
    outgoing = anchors.filter((F.col("anchor_file") == file) & F.col("anchor_line").between(start, end)).select("eid")
    incoming = anchors.filter("src <> dst").join(defined.select(F.col("vid").alias("dst")), "dst", "left_semi").select("eid")
    role = lambda df, c, r: df.select(F.lit(r).alias("role"), F.col(c).cast("long").alias("id"))
    return role(defined, "vid", "defined").union(role(outgoing, "eid", "outgoing")).union(role(incoming, "eid", "incoming"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("vid").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reference_importance(edges: DataFrame) -> DataFrame:
    """log1p(in-degree) over that of the largest, four digits."""
    d = edges.filter(in_layer("reference")).groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias("degree"))
    top = d.agg(F.max("degree").alias("most"))
    return d.crossJoin(F.broadcast(top)).select("vid", "degree", F.bround(F.log1p(F.col("degree").cast("double")) / F.log1p(F.col("most").cast("double")), 4).alias("importance"))


def hub_prune(edges: DataFrame, importance: DataFrame, cap: int = 8) -> DataFrame:
    """At most ``cap`` outgoing edges of a node, by the target's importance; how many were hidden."""
    rows = edges.select("src", "dst").distinct().join(importance.select(F.col("vid").alias("dst"), "importance"), "dst", "left").fillna(0.0, ["importance"])
    placed = rows.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy(F.desc("importance"), "dst"))).withColumn("hidden", F.greatest(F.count("*").over(W.partitionBy("src")) - cap, F.lit(0)))
    return placed.filter(F.col("n") <= cap).select("src", "dst", "importance", "hidden")


def entry_ratio(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.select("vid", F.col("in_degree").alias("ref_count"), (F.col("out_degree") / (F.col("in_degree") + F.col("out_degree"))).alias("entry"))


def rank_percentile(rows: DataFrame, by: str, within: str | None = None) -> DataFrame:
    """Rank over n - 1; zero below three rows. ``within`` keeps one partition from sorting all."""
    spec = (W.partitionBy(within) if within else W.partitionBy()).orderBy(by)
    n = F.count("*").over(W.partitionBy(within) if within else W.partitionBy())
    return rows.withColumn("percentile", F.when(n < 3, 0.0).otherwise(F.percent_rank().over(spec)))


def module_projection(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between modules (vid, module); the weight is the distinct symbol pairs."""
    pairs = edges.select("src", "dst").distinct()
    a, b = modules.select(F.col("vid").alias("src"), F.col("module").alias("from_module")), modules.select(F.col("vid").alias("dst"), F.col("module").alias("to_module"))
    return pairs.join(a, "src").join(b, "dst").filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("weight"))


def unique_labels(rows: DataFrame, display: str, name: str) -> DataFrame:
    """Readable unless it collides."""
    n = F.count("*").over(W.partitionBy(display))
    return rows.withColumn("label", F.when(n > 1, F.concat_ws(" ", F.col(display), F.concat(F.lit("("), F.col(name), F.lit(")")))).otherwise(F.col(display)))


def hierarchy(files: DataFrame, path: str = "file") -> DataFrame:
    """(id, parent, kind, depth) of all directories and files; the root is the empty path."""
    parts = F.split(path, "/", -1)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("id"), i.alias("depth"), (i == F.size(parts)).alias("leaf")))
    rows = files.select(F.explode(prefixes).alias("p")).select("p.*").groupBy("id").agg(F.min("depth").alias("depth"), F.max("leaf").alias("leaf"))
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") == 1, F.lit("")).otherwise(F.regexp_replace("id", "/[^/]*$", "")))
    return rows.select("id", parent.alias("parent"), F.when(F.col("depth") == 0, "root").when(F.col("leaf"), "file").otherwise("directory").alias("kind"), "depth")


def rollup_counts(files: DataFrame, path: str, value: str) -> DataFrame:
    """Sum and maximum of a value over everything below each directory."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(above).alias("id"), value).groupBy("id").agg(F.sum(value).alias("total"), F.max(value).alias("most"))


def common_ancestor(a: Column, b: Column) -> Column:
    """Lowest common directory of two paths."""
    x, y = F.split(a, "/", -1), F.split(b, "/", -1)
    n = F.least(F.size(x), F.size(y))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(x, F.lit(1), i) == F.slice(y, F.lit(1), i)))
    return F.array_join(F.slice(x, F.lit(1), same), "/")


def codemap(edges: DataFrame, seeds: DataFrame, depth: int = 4, max_nodes: int = 120, anchors: int = 12) -> DataFrame:
    """Pairs within reach of the seeds: how many anchors, and the smallest of them."""
    near = bfs(edges, seeds, depth).orderBy("depth", "vid").limit(max_nodes).select("vid")
    own = edges.filter("src <> dst").join(near.withColumnRenamed("vid", "src"), "src", "left_semi").join(near.withColumnRenamed("vid", "dst"), "dst", "left_semi")
    return own.groupBy("src", "dst").agg(F.count("*").alias("anchors"), F.slice(F.sort_array(F.collect_set("anchor_line")), 1, anchors).alias("lines"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation: each round a vertex takes its neighbours' commonest label, the smallest of equals."""
    both = checkpoint(both_ways(edges).filter(F.col("from") != F.col("to")).select("from", "to").distinct())
    label = both.select(F.col("from").alias("vid")).distinct().withColumn("label", F.col("vid"))
    for _ in range(rounds):
        votes = both.join(label, both["to"] == label["vid"]).groupBy("from", "label").agg(F.count("*").alias("n"))
        label = checkpoint(votes.groupBy(F.col("from").alias("vid")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
    return label


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(communities, q): the share of undirected edges within communities less what degrees alone would give."""
    one = edges.select(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("d")).filter("s <> d").distinct()
    ends = one.join(labels.select(F.col("vid").alias("s"), F.col("label").alias("x")), "s").join(labels.select(F.col("vid").alias("d"), F.col("label").alias("y")), "d").select("x", "y")
    total = ends.agg(F.count("*").alias("m"), F.count_if(F.col("x") == F.col("y")).alias("inside"))
    degree = ends.select(F.explode(F.array("x", "y")).alias("label")).groupBy("label").agg(F.count("*").alias("d"))
    spread = degree.agg(F.count("*").alias("communities"), F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return total.crossJoin(spread).select("communities", F.when(F.col("m") > 0, F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("q"))


def constrain(vertices: DataFrame, edges: DataFrame, surface: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only vertices on the surface (files), and edges with both ends there."""
    own = vertices.join(surface, "file", "left_semi")
    ids = own.select("vid")
    return own, edges.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi")


def surface_digest(rows: DataFrame, group: str, order: list[str], fields: list[str]) -> DataFrame:
    """SHA-256 over the ordered fields of each group."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"]), "\n"), 256).alias("digest"))


def alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side alone: (missing, extra)."""
    missing, extra = left.exceptAll(right).agg(F.count("*").alias("missing")), right.exceptAll(left).agg(F.count("*").alias("extra"))
    return missing.crossJoin(extra).withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0))


def coverage(tracked: DataFrame, represented: DataFrame, group: str, file: str = "file") -> DataFrame:
    """Tracked files and those represented, by group, with their ratio."""
    rows = tracked.select(group, file).distinct().join(represented.select(file).distinct().withColumn("__in", F.lit(1)), file, "left")
    return rows.groupBy(group).agg(F.count("*").alias("tracked"), F.count("__in").alias("represented")).withColumn("ratio", F.col("represented") / F.col("tracked"))


# Terms that tell the role of a symbol on a route.
ENDPOINT_TERMS = ["apply", "check", "detect", "handle", "handler", "main", "process", "run", "validate"]
BRIDGE_TERMS = ["adapter", "build", "builder", "download", "factory", "fetch", "make", "new", "open", "replace", "replacement", "resolver", "retrieve", "template"]
PROVIDER_TERMS = ["cache", "config", "default", "directory", "env", "location", "path", "provider", "property", "setting", "url", "value"]


def roles(terms: Column, query: Column, kind: Column, leaf: Column, lines: Column) -> Column:
    """Role of a route node: by its type, by how its name begins, or by telling terms where it shares any with the query."""
    has = lambda words: F.arrays_overlap(terms, F.array(*[F.lit(x) for x in words]))
    shared = F.arrays_overlap(terms, query)
    return (
        F.when(kind.isin("class", "field"), "type")
        .when(F.lower(leaf).rlike("^(get|default)") | (has(PROVIDER_TERMS) & shared), "provider")
        .when(F.lower(leaf).rlike("^(new|make|build)") | (has(BRIDGE_TERMS) & shared), "bridge")
        .when(kind.isin("function", "method") & ((lines > 1) | has(ENDPOINT_TERMS)), "endpoint")
        .otherwise("support")
    )


def trace(edges: DataFrame, source: int, target: int, max_hops: int = 6) -> DataFrame:
    """(step, vid) of a shortest path of at most ``max_hops`` edges, forwards or else backwards; empty if there is none."""
    steps = checkpoint(edges.select("src", "dst"))  # for both ways
    there = _path(steps, source, target, max_hops)
    if not there.isEmpty():
        return there
    back = _path(steps, target, source, max_hops)
    last = back.agg(F.max("step").alias("last"))  # one row
    return back.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("step")).alias("step"), "vid")


def file_tree(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, depth, line): folders and files as an indented tree, a folder before what it holds, in order of ``path``."""
    parts = F.split("file", "/")
    own = files.select("file").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i - 1).alias("depth"), (i < F.size(parts)).alias("folder")))).alias("x"))
    rows = own.select("x.*").groupBy("path", "depth").agg(F.max("folder").alias("folder"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.substring_index("path", "/", -1), F.when(F.col("folder"), "/").otherwise(""))
    out = rows.select("path", "depth", line.alias("line"))
    return out.orderBy("path").limit(limit) if limit else out


def edge_labels(edges: DataFrame, cache: DataFrame, fields: list[str]) -> DataFrame:
    """Edges with the label cached under the SHA-256 of their fields, or null where one has to be written."""
    keyed = edges.withColumn("label_key", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256))
    return keyed.join(cache.select("label_key", "label"), "label_key", "left")


def range_query_by_symbol(vertices: DataFrame, anchors: DataFrame, symbol: str) -> DataFrame:
    """As ``range_query`` for the spans of every vertex (vid, name, file, start_line, end_line) of a unified name: (role, id)."""
    own = vertices.filter(F.coalesce(F.col("unified_name") if "unified_name" in vertices.columns else F.col("name"), F.col("name")) == symbol)
    s = own.select("file", F.col("start_line").alias("__s"), F.col("end_line").alias("__e")).distinct()
    defined = vertices.join(s, "file").filter((F.col("start_line") <= F.col("__e")) & (F.col("end_line") >= F.col("__s"))).select("vid").distinct()
    outgoing = anchors.join(s, anchors["anchor_file"] == s["file"]).filter(F.col("anchor_line").between(F.col("__s"), F.col("__e"))).select("eid").distinct()
    incoming = anchors.filter("src <> dst").join(defined.select(F.col("vid").alias("dst")), "dst", "left_semi").select("eid")
    role = lambda df, c, r: df.select(F.lit(r).alias("role"), F.col(c).cast("long").alias("id"))
    return role(defined, "vid", "defined").union(role(outgoing, "eid", "outgoing")).union(role(incoming, "eid", "incoming"))
