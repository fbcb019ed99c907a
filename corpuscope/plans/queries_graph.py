"""Queries of the graph operators over the star schema as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import graph
from corpuscope.plans.registry import query
from corpuscope.plans.views import EDGES_SQL, FILES_SQL, VERTICES_SQL, edges, files, table, vertices

NATION = "SELECT CAST(100 + n_nationkey AS BIGINT) AS vid FROM nation WHERE n_nationkey < 3"


def _nations(spark, sf):
    return table(spark, sf, "nation").filter("n_nationkey < 3").select((F.col("n_nationkey") + 100).cast("long").alias("vid"))


@query("SELECT type, count(*) AS vertices, CAST(sum(vid % 1000) AS BIGINT) AS check_sum FROM vertices GROUP BY type", VERTICES_SQL)
def graph_vertices(spark, sf):
    return vertices(spark, sf).groupBy("type").agg(F.count("*").alias("vertices"), F.sum(F.col("vid") % 1000).alias("check_sum"))


@query("SELECT user_id AS name, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY user_id")
def vertex_upsert(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("seq"), "event_type")
    return graph.upsert_vertices(e).select("name", "event_type", "seq")


@query("SELECT src, dst, type, min(eid) AS eid FROM edges WHERE type = 'reference' GROUP BY src, dst, type, anchor_file, anchor_line", EDGES_SQL)
def edge_dedup(spark, sf):
    e = edges(spark, sf).filter("type = 'reference'")
    return graph.dedup_edges(e.unionByName(e)).select("src", "dst", "type", "eid")


@query("SELECT user_id AS name, arg_max(event_id, CASE WHEN event_type = 'purchase' THEN 1000000000 ELSE 0 END + event_id) AS shard FROM events GROUP BY user_id")
def graph_merge(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("shard"), (F.col("event_type") == "purchase").alias("has_definition"))
    return graph.merge_vertices(e).select("name", "shard")


@query(
    """WITH m AS (SELECT 'all' AS layer, * FROM edges UNION ALL SELECT 'containment', * FROM edges WHERE type = 'contain' UNION ALL SELECT 'dependency', * FROM edges WHERE type IN ('reference', 'import', 'type-use')
  UNION ALL SELECT type, * FROM edges WHERE type IN ('reference', 'import', 'type-use'))
SELECT layer, count(*) AS edges, (SELECT count(DISTINCT v) FROM (SELECT src AS v, layer AS l FROM m UNION ALL SELECT dst, layer FROM m) WHERE l = m.layer) AS nodes FROM m GROUP BY layer""",
    EDGES_SQL,
)
def edge_layers(spark, sf):
    return graph.layer_summary(edges(spark, sf))


@query(f"SELECT dst AS vid, src AS \"to\", min(eid) AS eid FROM edges WHERE type = 'contain' AND dst IN ({NATION}) GROUP BY ALL", EDGES_SQL)
def typed_neighbors(spark, sf):
    return graph.neighbours(edges(spark, sf), _nations(spark, sf), "in", ["contain"])


@query(
    """WITH s AS (SELECT CAST(1000000000 + c_custkey AS BIGINT) AS vid, c_custkey AS rank, CAST(c_custkey AS DOUBLE) AS score FROM customer),
h AS (SELECT vid, rank, score, src AS t, min(eid) AS eid FROM edges JOIN s ON dst = vid WHERE type = 'reference' GROUP BY ALL)
SELECT vid AS seed, t AS vid, CAST(n AS BIGINT) AS n, score * 0.5 AS score FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY eid, t) AS n FROM h) WHERE n <= 5""",
    EDGES_SQL,
)
def one_hop_expand(spark, sf):
    seeds = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000000).alias("vid"), F.col("c_custkey").alias("rank"), F.col("c_custkey").cast("double").alias("score"))
    x = graph.expand_one_hop(seeds, edges(spark, sf), vertices(spark, sf), 5)
    return x.select("seed", "vid", F.col("n").cast("long").alias("n"), "score")


@query(
    f"""WITH RECURSIVE steps AS (SELECT DISTINCT dst AS f, src AS t FROM edges), r AS (SELECT vid, 0 AS depth FROM ({NATION}) UNION SELECT t, depth + 1 FROM r JOIN steps ON f = vid WHERE depth < 2)
SELECT vid, CAST(min(depth) AS INT) AS depth FROM r GROUP BY vid""",
    EDGES_SQL,
)
def bfs_impact(spark, sf):
    return graph.bfs(edges(spark, sf), _nations(spark, sf), 2, "in")


@query(
    """WITH RECURSIVE own AS (SELECT * FROM edges WHERE type = 'reference'), steps AS (SELECT DISTINCT src AS f, dst AS t FROM own UNION SELECT dst, src FROM own),
r AS (SELECT CAST(4000000005 AS BIGINT) AS vid, 0 AS depth UNION SELECT t, depth + 1 FROM r JOIN steps ON f = vid WHERE depth < 2),
n AS (SELECT vid FROM (SELECT vid, min(depth) AS depth FROM r GROUP BY vid) ORDER BY depth, vid LIMIT 60)
SELECT eid, src, dst, type FROM own WHERE src IN (SELECT vid FROM n) AND dst IN (SELECT vid FROM n) ORDER BY eid LIMIT 200""",
    EDGES_SQL,
)
def dependency_subgraph(spark, sf):
    seed = spark.range(1).select(F.lit(4000000005).cast("long").alias("vid"))
    return graph.dependency_subgraph(edges(spark, sf), seed, 2, "both", 60, 200)


@query(
    """WITH RECURSIVE steps AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT 4000000007 UNION ALL SELECT dst FROM edges WHERE src = 4000000007) OR src < 1000000000), r AS (SELECT CAST(4000000007 AS BIGINT) AS vid, 0 AS step, ['x'] AS p UNION ALL SELECT dst, step + 1, list_append(p, CAST(dst AS VARCHAR)) FROM r JOIN steps ON src = vid WHERE step < 3),
c AS (SELECT 1000000000 + o_custkey AS cust, 100 + c_nationkey AS nat, 1 + n_regionkey AS reg FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7)
SELECT CAST(unnest([0, 1, 2]) AS INT) AS step, CAST(unnest([4000000007, cust, nat]) AS BIGINT) AS vid FROM c""",
    EDGES_SQL,
)
def shortest_path(spark, sf):
    """From order 7 to its customer's nation; the customer has the smallest id of the parents at that depth."""
    row = table(spark, sf, "orders").filter("o_orderkey = 7").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).first()
    return graph.shortest_path(edges(spark, sf), 4000000007, 100 + row.c_nationkey)


PPR_STEP = """r{n} AS (SELECT coalesce(m.vid, s.vid) AS vid, 0.85 * coalesce(m, 0) + coalesce(z, 0) * (0.15 + 0.85 * (1 - (SELECT coalesce(sum(m), 0) FROM m{n}))) AS rank FROM m{n} m FULL JOIN s ON m.vid = s.vid)"""
PPR_SQL = (
    f"WITH s AS (SELECT vid, 1.0::DOUBLE / 3 AS z FROM ({NATION})), l AS (SELECT dst AS src, src AS dst, count(*) AS w FROM edges WHERE type = 'contain' OR src < 4000000000 GROUP BY ALL), f AS (SELECT src, dst, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY src) AS share FROM l), r0 AS (SELECT vid, z AS rank FROM s), "
    + ", ".join(f"m{n} AS (SELECT dst AS vid, sum(rank * share) AS m FROM r{n - 1} JOIN f ON r{n - 1}.vid = f.src GROUP BY dst), " + PPR_STEP.format(n=n) for n in (1, 2, 3))
    + " SELECT vid, round(rank, 8) AS rank FROM r3"
)


@query(PPR_SQL, EDGES_SQL)
def ppr_fixed_iter(spark, sf):
    e = edges(spark, sf).filter("type = 'contain' or src < 4000000000").select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return graph.personalized_pagerank(e, _nations(spark, sf), 3).select("vid", F.round("rank", 8).alias("rank"))


@query(
    """WITH d AS (SELECT 'defined' AS role, vid AS id FROM vertices WHERE file = 'parts/Brand#1/ECONOMY' AND vid % 100 <= 40 AND vid % 100 + 5 >= 10),
o AS (SELECT 'outgoing' AS role, eid AS id FROM edges WHERE anchor_file = 7 AND anchor_line BETWEEN 10 AND 40)
SELECT * FROM d UNION ALL SELECT * FROM o UNION ALL SELECT 'incoming', eid FROM edges WHERE dst IN (SELECT id FROM d) AND src <> dst""",
    VERTICES_SQL, EDGES_SQL,
)
def range_query(spark, sf):
    v = vertices(spark, sf).withColumn("start_line", F.col("vid") % 100).withColumn("end_line", F.col("vid") % 100 + 5)
    e = edges(spark, sf).withColumn("anchor_file", F.col("anchor_file").cast("string"))
    return graph.range_query(v, e, "parts/Brand#1/ECONOMY", 10, 40).union(graph.range_query(v.limit(0), e, "7", 10, 40))


@query("WITH d AS (SELECT dst AS vid, count(*) AS degree FROM edges WHERE type = 'reference' GROUP BY dst) SELECT vid, degree, round_even(ln(1 + degree) / ln(1 + (SELECT max(degree) FROM d)), 4) AS importance FROM d", EDGES_SQL)
def importance_log1p(spark, sf):
    return graph.reference_importance(edges(spark, sf))


@query(
    """WITH d AS (SELECT dst AS vid, count(*) AS degree FROM edges WHERE type = 'reference' GROUP BY dst), i AS (SELECT vid, round_even(ln(1 + degree) / ln(1 + (SELECT max(degree) FROM d)), 4) AS importance FROM d),
p AS (SELECT src, e.dst, coalesce(importance, 0) AS importance, row_number() OVER (PARTITION BY src ORDER BY coalesce(importance, 0) DESC, e.dst) AS n, greatest(count(*) OVER (PARTITION BY src) - 3, 0) AS hidden FROM (SELECT DISTINCT src, dst FROM edges WHERE type = 'reference') e LEFT JOIN i ON e.dst = i.vid)
SELECT src, dst, importance, hidden FROM p WHERE n <= 3""",
    EDGES_SQL,
)
def hub_prune(spark, sf):
    e = edges(spark, sf).filter("type = 'reference'")
    return graph.hub_prune(e, graph.reference_importance(e), 3)


@query("SELECT vid, CAST(sum(i) AS BIGINT) AS ref_count, round(sum(o) / (sum(i) + sum(o)), 9) AS entry FROM (SELECT src AS vid, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY vid", EDGES_SQL)
def entry_ratio(spark, sf):
    return graph.entry_ratio(edges(spark, sf)).withColumn("entry", F.round("entry", 9))


@query("SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS percentile FROM customer")
def importance_percentile(spark, sf):
    return graph.rank_percentile(table(spark, sf, "customer"), "c_acctbal", "c_nationkey").select("c_custkey", F.round("percentile", 9).alias("percentile"))


@query(
    """WITH m AS (SELECT vid, split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS module FROM vertices), p AS (SELECT DISTINCT src, dst FROM edges)
SELECT a.module AS from_module, b.module AS to_module, count(*) AS weight FROM p JOIN m a ON p.src = a.vid JOIN m b ON p.dst = b.vid WHERE a.module <> b.module GROUP BY ALL""",
    VERTICES_SQL, EDGES_SQL,
)
def module_projection(spark, sf):
    return graph.module_projection(edges(spark, sf), vertices(spark, sf).select("vid", F.substring_index("file", "/", 2).alias("module")))


@query("SELECT vid, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || file || ')' ELSE name END AS label FROM vertices WHERE type = 'part'", VERTICES_SQL)
def unique_labels(spark, sf):
    return graph.unique_labels(vertices(spark, sf).filter("type = 'part'"), "name", "file").select("vid", "label")


@query(
    """WITH p AS (SELECT string_split(file, '/') AS s FROM files), x AS (SELECT s, unnest(range(0, len(s) + 1)) AS d FROM p), y AS (SELECT array_to_string(s[1:d], '/') AS id, d, d = len(s) AS leaf FROM x)
SELECT id, CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE regexp_replace(id, '/[^/]*$', '') END AS parent, CASE WHEN d = 0 THEN 'root' WHEN bool_or(leaf) THEN 'file' ELSE 'directory' END AS kind, CAST(d AS INT) AS depth FROM y GROUP BY id, d""",
    FILES_SQL,
)
def hierarchy(spark, sf):
    return graph.hierarchy(files(spark, sf).select("file"))


@query("WITH p AS (SELECT string_split(file, '/') AS s, length(content) AS n FROM files), x AS (SELECT s, n, unnest(range(0, len(s) + 1)) AS d FROM p) SELECT array_to_string(s[1:d], '/') AS id, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM x GROUP BY 1", FILES_SQL)
def hierarchy_rollup(spark, sf):
    return graph.rollup_counts(files(spark, sf).select("file", F.length("content").cast("long").alias("n")), "file", "n")


@query("SELECT a.vid, CASE WHEN split_part(a.file, '/', 1) <> split_part(b.file, '/', 1) THEN '' WHEN split_part(a.file, '/', 2) <> split_part(b.file, '/', 2) THEN split_part(a.file, '/', 1) ELSE split_part(a.file, '/', 1) || '/' || split_part(a.file, '/', 2) END AS ancestor FROM files a JOIN files b ON b.vid = a.vid + 20", FILES_SQL)
def common_ancestor(spark, sf):
    f = files(spark, sf).select("vid", "file")
    g = f.select((F.col("vid") - 20).alias("vid"), F.col("file").alias("other"))
    return f.join(g, "vid").select("vid", graph.common_ancestor(F.col("file"), F.col("other")).alias("ancestor"))


@query(
    """WITH RECURSIVE steps AS (SELECT DISTINCT src AS f, dst AS t FROM edges), r AS (SELECT CAST(4000000011 AS BIGINT) AS vid, 0 AS depth UNION SELECT t, depth + 1 FROM r JOIN steps ON f = vid WHERE depth < 2),
n AS (SELECT vid FROM (SELECT vid, min(depth) AS depth FROM r GROUP BY vid) ORDER BY depth, vid LIMIT 120)
SELECT src, dst, count(*) AS anchors, coalesce(string_agg(DISTINCT CAST(anchor_line AS VARCHAR), ',' ORDER BY CAST(anchor_line AS VARCHAR)), '') AS lines FROM edges WHERE src <> dst AND src IN (SELECT vid FROM n) AND dst IN (SELECT vid FROM n) GROUP BY src, dst""",
    EDGES_SQL,
)
def codemap(spark, sf):
    seed = spark.range(1).select(F.lit(4000000011).cast("long").alias("vid"))
    return graph.codemap(edges(spark, sf), seed, 2).select("src", "dst", "anchors", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


_ROUND = "l{n} AS (SELECT vid, label FROM (SELECT f AS vid, label, row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, label) AS k FROM b JOIN l{m} ON t = vid GROUP BY f, label) WHERE k = 1)"
COMMUNITIES_SQL = "WITH c AS (SELECT src, dst FROM edges WHERE type = 'contain'), b AS (SELECT src AS f, dst AS t FROM c UNION SELECT dst, src FROM c), l0 AS (SELECT DISTINCT f AS vid, f AS label FROM b), " + ", ".join(_ROUND.format(n=n, m=n - 1) for n in (1, 2, 3))


@query(
    COMMUNITIES_SQL
    + """, e AS (SELECT a.label AS x, z.label AS y FROM (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM c WHERE src <> dst) JOIN l3 a ON a.vid = s JOIN l3 z ON z.vid = d), d AS (SELECT label, count(*) AS d FROM (SELECT x AS label FROM e UNION ALL SELECT y FROM e) GROUP BY label)
SELECT (SELECT count(*) FROM d) AS communities, round((SELECT count(*) FILTER (WHERE x = y) / count(*) FROM e) - (SELECT sum(d * d) FROM d) / pow(2 * (SELECT count(*) FROM e), 2), 9) AS q""",
    EDGES_SQL,
)
def modularity(spark, sf):
    """How well communities of containment cut the graph."""
    e = edges(spark, sf).filter("type = 'contain'")
    return graph.modularity(e, graph.communities(e, 3)).select("communities", F.round("q", 9).alias("q"))


@query(COMMUNITIES_SQL + " SELECT vid, label FROM l3", EDGES_SQL)
def communities(spark, sf):
    return graph.communities(edges(spark, sf).filter("type = 'contain'"), 3)


@query("WITH v AS (SELECT vid FROM vertices WHERE file LIKE 'parts/%' OR file LIKE 'suppliers/%') SELECT type, count(*) AS edges FROM edges WHERE src IN (SELECT vid FROM v) AND dst IN (SELECT vid FROM v) GROUP BY type", VERTICES_SQL, EDGES_SQL)
def constrain_surface(spark, sf):
    v = vertices(spark, sf)
    _, e = graph.constrain(v, edges(spark, sf), v.filter("file like 'parts/%' or file like 'suppliers/%'").select("file").distinct())
    return e.groupBy("type").agg(F.count("*").alias("edges"))


@query("SELECT file, sha256(string_agg(CAST(vid AS VARCHAR) || chr(31) || name, chr(10) ORDER BY vid)) AS digest FROM vertices GROUP BY file", VERTICES_SQL)
def surface_digest(spark, sf):
    return graph.surface_digest(vertices(spark, sf), "file", ["vid"], ["vid", "name"])


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)) AS missing, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)) AS extra, false AS ok")
def backend_alignment(spark, sf):
    o = table(spark, sf, "orders")
    return graph.alignment(o.filter("o_orderkey % 2 = 0").select("o_custkey"), o.filter("o_orderkey % 3 = 0").select("o_custkey"))


@query("SELECT name, count(*) AS tracked, count(*) FILTER (WHERE vid % 3 = 0) AS represented, round(count(*) FILTER (WHERE vid % 3 = 0) / count(*), 9) AS ratio FROM files GROUP BY name", FILES_SQL)
def source_coverage(spark, sf):
    f = files(spark, sf)
    return graph.coverage(f, f.filter("vid % 3 = 0"), "name").withColumn("ratio", F.round("ratio", 9))


@query("SELECT dst AS parent, count(*) AS children, min(src) AS first_child FROM edges WHERE type = 'contain' GROUP BY dst", EDGES_SQL)
def contained_entities(spark, sf):
    return edges(spark, sf).filter(graph.in_layer("containment")).groupBy(F.col("dst").alias("parent")).agg(F.count("*").alias("children"), F.min("src").alias("first_child"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'type' WHEN regexp_matches(p_name, '(^| )path( |$)') THEN 'provider' WHEN regexp_matches(p_name, '(^| )(old|new)( |$)') THEN 'bridge' WHEN p_size % 2 = 0 OR regexp_matches(p_name, '(^| )(run|process)( |$)') THEN 'endpoint' ELSE 'support' END AS role
FROM part WHERE NOT regexp_matches(p_name, '^(get|default|make|build|new)')"""
)
def route_roles(spark, sf):
    p = table(spark, sf, "part").filter(~F.col("p_name").rlike("^(get|default|make|build|new)"))
    name = F.regexp_replace("p_name", "(^| )old( |$)", "$1new$2")
    kind = F.when(F.col("p_size") % 7 == 0, "class").otherwise("function")
    return p.select("p_partkey", graph.roles(F.split(name, " "), F.array(F.lit("new"), F.lit("path")), kind, F.col("p_name"), F.when(F.col("p_size") % 2 == 0, 9).otherwise(1)).alias("role"))
