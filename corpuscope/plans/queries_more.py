"""Queries of navigation, expansion, subgraph maintenance and composed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import facts, filters, graph, incremental, lexical, navigation, ranking, vectors
from corpuscope.plans.queries_rank import VEC
from corpuscope.plans.queries_text import BM25_SQL, BM25_TERMS
from corpuscope.plans.registry import query
from corpuscope.plans.views import CANDIDATES_SQL, EDGES_SQL, FILES_SQL, VERTICES_SQL, candidates, edges, files, table, vertices


@query("WITH w AS (SELECT DISTINCT p_name AS wanted FROM part) SELECT wanted, CASE WHEN count(*) = 1 THEN min(vid) END AS vid, count(*) AS matches FROM w JOIN vertices ON name = wanted GROUP BY wanted", VERTICES_SQL)
def resolve_names(spark, sf):
    return navigation.resolve_names(table(spark, sf, "part").select(F.col("p_name").alias("wanted")), vertices(spark, sf))


@query(
    """WITH h AS (SELECT o_orderkey, dst AS vid, min(eid) AS eid FROM orders JOIN edges ON anchor_file = o_orderkey AND anchor_line = 1 GROUP BY ALL)
SELECT o_orderkey, vid, row_number() OVER (PARTITION BY o_orderkey ORDER BY eid, vid) AS n FROM h""",
    EDGES_SQL,
)
def lsp_definition(spark, sf):
    points = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("file"), F.lit(1).cast("long").alias("line"))
    return navigation.definition_at(points, edges(spark, sf), "o_orderkey").withColumn("n", F.col("n").cast("long"))


@query("WITH h AS (SELECT DISTINCT dst AS vid, anchor_file, anchor_line FROM edges WHERE anchor_line IS NOT NULL) SELECT vid, anchor_file, anchor_line FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY anchor_file, anchor_line) AS n FROM h) WHERE n <= 4", EDGES_SQL)
def lsp_references(spark, sf):
    return navigation.references(vertices(spark, sf).filter("type = 'part'"), edges(spark, sf), 4).select("vid", "anchor_file", "anchor_line")


@query(
    """WITH w AS (SELECT p_partkey, unnest(list_filter(string_split(lower('run ' || p_name || ' cache'), ' '), lambda x: length(x) >= 3)) AS t FROM part),
t AS (SELECT p_partkey, t FROM w UNION SELECT p_partkey, left(t, CAST(length(t) - length(x) AS BIGINT)) FROM w, (VALUES ('ing'), ('ers'), ('er'), ('ments'), ('ment'), ('es'), ('s')) v(x) WHERE length(t) > length(x) + 2 AND ends_with(t, x)),
n AS (SELECT p_partkey, count(*) FILTER (WHERE t IN ('widget', 'anvil', 'retrieval', 'retrieve', 'download', 'cache')) AS shared FROM t GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'type' WHEN shared > 0 THEN 'provider' ELSE 'endpoint' END AS role, CAST(shared AS INT) AS shared,
  5.0 * shared + CASE WHEN p_size % 2 = 0 THEN greatest(0, 8 - p_size) ELSE 3 END + CASE WHEN p_size % 5 = 0 THEN 1.0 WHEN shared > 0 THEN 2.0 ELSE 4.0 END AS score FROM n JOIN part USING (p_partkey)"""
)
def lsp_route(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 5 == 0, "class").otherwise("function")
    nodes = p.select("p_partkey", F.concat(F.lit("run_"), F.regexp_replace("p_name", " ", "_"), F.lit("_cache()")).alias("name"), kind.alias("type"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("rank"))
    return navigation.route_scores(nodes, ["widget", "anvil", "retrieval"]).select("p_partkey", "role", "shared", F.round("score", 6).alias("score"))


@query(
    f"""WITH RECURSIVE seeds AS (SELECT CAST(1000000000 + c_custkey AS BIGINT) AS vid, c_custkey AS rank FROM customer WHERE c_custkey BETWEEN 1 AND 5), own AS (SELECT * FROM edges WHERE type = 'contain'), steps AS (SELECT src AS f, dst AS t FROM own UNION SELECT dst, src FROM own),
r AS (SELECT vid, 0 AS depth FROM seeds UNION SELECT t, depth + 1 FROM r JOIN steps ON f = vid WHERE depth < 2), n AS (SELECT vid, min(depth) AS depth FROM r GROUP BY vid),
a AS (SELECT vid, 0 AS tier, rank AS place FROM seeds UNION ALL SELECT vid, 1, depth FROM n WHERE depth > 0)
SELECT vid, CAST(min(tier * 1000 + place) // 1000 AS BIGINT) AS tier, CAST(min(tier * 1000 + place) % 1000 AS BIGINT) AS place FROM a GROUP BY vid ORDER BY min(tier * 1000 + place), vid LIMIT 40""",
    EDGES_SQL,
)
def region_expand(spark, sf):
    seeds = table(spark, sf, "customer").filter("c_custkey between 1 and 5").select((F.col("c_custkey") + 1000000000).alias("vid"), F.col("c_custkey").alias("rank"), F.lit(1.0).alias("score"))
    return navigation.expand_candidates(seeds, edges(spark, sf).filter("type = 'contain'"), vertices(spark, sf), 40)


@query("SELECT file, count(*) AS n_symbols, CAST(min(vid % 100) AS BIGINT) AS first_line, CAST(max(vid % 100 + 6) AS BIGINT) AS past_line, coalesce(any_value(n), 0) AS n_edges FROM vertices LEFT JOIN (SELECT file AS f, count(*) AS n FROM edges JOIN vertices ON src = vid GROUP BY file) ON f = file GROUP BY file", VERTICES_SQL, EDGES_SQL)
def graph_batches(spark, sf):
    v = vertices(spark, sf).withColumn("start_line", F.col("vid") % 100).withColumn("end_line", F.col("vid") % 100 + 5)
    return facts.graph_to_batches(v, edges(spark, sf))


@query(
    """WITH o AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 50 AS line, l_partkey % 500 AS symbol, l_linenumber % 2 AS d FROM lineitem)
SELECT a.file AS source, b.file AS target, min(a.line) AS anchor_line FROM o a JOIN (SELECT DISTINCT symbol, file FROM o WHERE d = 1) b ON a.symbol = b.symbol WHERE a.d = 0 AND a.line BETWEEN 0 AND 3 AND a.file <> b.file GROUP BY ALL"""
)
def import_edges(spark, sf):
    p = F.col("l_partkey")
    o = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), (p % 50).alias("start_line"), (p % 500).alias("symbol"), (F.col("l_linenumber") % 2).cast("int").alias("roles")).distinct()
    spans = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(0).cast("long").alias("s"), F.lit(3).cast("long").alias("e"))
    return facts.import_edges(spans, o, o.filter("roles = 1"))


@query("WITH g AS (SELECT vid FROM vertices WHERE file LIKE 'parts/Brand#1/%') SELECT (SELECT count(*) FROM vertices WHERE NOT file LIKE 'parts/Brand#1/%') AS vertices, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT vid FROM g) AND dst NOT IN (SELECT vid FROM g)) AS edges, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT vid FROM g) AND dst IN (SELECT vid FROM g)) AS severed", VERTICES_SQL, EDGES_SQL)
def delete_subgraph(spark, sf):
    v = vertices(spark, sf)
    left, kept, severed = incremental.delete_subgraph(v, edges(spark, sf), v.filter("file like 'parts/Brand#1/%'").select("file").distinct())
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(left, "vertices").crossJoin(n(kept, "edges")).crossJoin(n(severed, "severed"))


@query("SELECT eid, src, 9000000000 + dst AS dst FROM edges WHERE type = 'contain' AND dst >= 100 AND dst < 200", EDGES_SQL)
def remap_severed(spark, sf):
    nations = vertices(spark, sf).filter("type = 'nation'").select("vid", "name")
    severed = edges(spark, sf).filter("type = 'contain' and dst >= 100 and dst < 200")
    return incremental.remap_severed(severed, nations, nations.withColumn("vid", F.col("vid") + 9000000000)).select("eid", "src", "dst")


@query("SELECT source AS file, count(*) AS chunks FROM documents WHERE NOT (source = 'src1' AND doc_id % 2 = 0) GROUP BY source")
def delete_files(spark, sf):
    c = table(spark, sf, "documents").select(F.col("source").alias("file"), (F.col("doc_id") % 2).cast("string").alias("level"))
    return incremental.delete_files(c, c.filter("file = 'src1'").select("file").distinct(), "0").groupBy("file").agg(F.count("*").alias("chunks"))


@query("WITH t AS (SELECT conv_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM conversations), r AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2), c AS (SELECT w[i] || ' ' || w[i + 1] AS prefix, w[i + 2] AS nxt, count(*) AS times FROM r GROUP BY ALL) SELECT prefix, arg_min(nxt, lpad(CAST(1000000 - times AS VARCHAR), 8, '0') || nxt) AS next, max(times) AS times FROM c GROUP BY prefix")
def draft_continuations(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", F.split(F.lower("text"), "[^a-z]+", -1).alias("w"))
    return navigation.continuations(t, "conv_id", "w", 2)


@query("WITH f AS (SELECT file, name, min(vid) AS vid FROM vertices WHERE type = 'nation' GROUP BY ALL), b AS (SELECT DISTINCT src AS f, dst AS t FROM edges WHERE type = 'contain' UNION SELECT dst, src FROM edges WHERE type = 'contain') SELECT vid AS \"from\", t AS \"to\" FROM (SELECT vid, t, row_number() OVER (PARTITION BY vid ORDER BY t) AS n FROM f JOIN b ON b.f = vid) WHERE n <= 6", VERTICES_SQL, EDGES_SQL)
def answer_neighbours(spark, sf):
    v = vertices(spark, sf)
    return navigation.answer_neighbours(v.filter("type = 'nation'").select("file", "name"), v, edges(spark, sf).filter("type = 'contain'"), 6).select("from", "to")


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view_n, round(avg(value) FILTER (WHERE event_type = 'view' AND event_id % 2 = 0), 6) AS view_mean, round(stddev_pop(value) FILTER (WHERE event_type = 'view' AND event_id % 2 = 0), 6) AS view_std, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS view_newest,
count(*) FILTER (WHERE event_type = 'click') AS click_n, round(avg(value) FILTER (WHERE event_type = 'click' AND event_id % 2 = 0), 6) AS click_mean, round(stddev_pop(value) FILTER (WHERE event_type = 'click' AND event_id % 2 = 0), 6) AS click_std, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS click_newest FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'click') > 0"""
)
def trial_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("valid", F.col("event_id") % 2 == 0).withColumn("created", F.col("event_id"))
    t = navigation.trial_summary(e, ["user_id"], "event_type", ["view", "click"]).filter("view_n > 0 and click_n > 0")
    return t.select("user_id", *[F.round(c, 6).alias(c) if c.endswith(("mean", "std")) else c for c in t.columns[1:]])


@query()
def focused_excerpts(spark, sf):
    f = files(spark, sf).select("vid", "content")
    return navigation.excerpt(f, "content", F.array(F.lit("license"), F.lit("password")), 600).select("vid", F.length("excerpt").alias("n"))


@query()
def anchor_windows(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("query"), F.col("event_type").alias("file"), (F.col("event_id") % 300).alias("s"), (F.col("event_id") % 300 + 2).alias("e"), F.col("event_id").alias("rank"))
    return navigation.merge_anchors(e, 2, 1, 40)


@query(
    """WITH n AS (SELECT o_orderkey AS id, o_custkey % 100 AS parent, round_even(o_orderkey % 17 / 17.0 - 0.12 * (o_orderkey % 3) - 0.04 * (o_orderkey % 5), 6) AS doi FROM orders)
SELECT id, parent, CAST(doi AS DOUBLE) AS doi FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY doi DESC, id) AS n FROM n) WHERE n <= 6"""
)
def hierarchy_view(spark, sf):
    k = F.col("o_orderkey")
    n = table(spark, sf, "orders").select(k.alias("id"), (F.col("o_custkey") % 100).alias("parent"), (k % 17 / 17.0).alias("importance"), (k % 3).alias("ref_distance"), (k % 5).alias("tree_distance"))
    return navigation.hierarchy_view(n, 6).select("id", "parent", "doi")


@query("SELECT vid, name FROM vertices WHERE type = 'nation' ORDER BY name, vid LIMIT 5", VERTICES_SQL)
def default_seed(spark, sf):
    v = vertices(spark, sf).filter("type = 'nation'")
    return navigation.default_seed(v, graph.entry_ratio(edges(spark, sf).limit(0)).select("vid", "entry"), ["main", "run"]).limit(5).select("vid", "name")


@query(
    BM25_SQL + f", c AS (SELECT doc_id FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 100), t AS (SELECT e.vec_id, {VEC} AS v FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id IN (SELECT doc_id FROM c)) SELECT vec_id, round(v, 5) AS score FROM t ORDER BY v DESC, vec_id LIMIT 10"
)
def hybrid_cascade(spark, sf):
    """Lexical candidates, then vectors among them alone."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    top = lexical.bm25(d, "doc_id", "text", BM25_TERMS).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(100)
    e = table(spark, sf, "embeddings").withColumn("node_id", F.col("vec_id"))
    return vectors.search_within(e, e.filter("vec_id = 0"), top.select(F.col("doc_id").alias("node_id")), 10).select("vec_id", F.round("score", 5).alias("score"))


@query(
    """SELECT node_id, round(sum(CASE WHEN coalesce(score, 0) = 0 THEN 1.0 / (rank + 1) ELSE score END), 6) AS score FROM (SELECT branch, rank - 1 AS rank, node_id, score FROM candidates) GROUP BY node_id""", CANDIDATES_SQL
)
def skill_merge(spark, sf):
    """Ranks from zero; the reciprocal falls back to the same values."""
    c = candidates(spark, sf).withColumn("rank", F.col("rank") - 1)
    return ranking.fuse(c, "node_id", "weighted", base=2).select("node_id", F.round("score", 6).alias("score"))


@query("SELECT vid FROM files WHERE file LIKE 'src1/%' AND NOT contains(file, '/build/') AND NOT contains(file, '/.hidden/') AND NOT file LIKE '%.md'", FILES_SQL)
def scope_filter(spark, sf):
    return files(spark, sf).filter(filters.in_scope(F.col("file"), "src1", exclude=["*.md"])).select("vid")


@query(
    r"""SELECT identifier, CAST(max(sc) AS BIGINT) AS score FROM (SELECT rank, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{3,}'))) AS identifier, CASE WHEN rank = 1 THEN 4 ELSE 3 END AS sc FROM candidates WHERE branch = 0) GROUP BY identifier""", CANDIDATES_SQL
)
def predicate_inference(spark, sf):
    c = candidates(spark, sf).filter("branch = 0")
    return lexical.predicate_scores(c, ["nothing"], 1_000_000).select("identifier", "score")


@query("SELECT page_id, contains(html, '<title>') AS titled, len(string_split(html, '<p>')) > 3 AS long_enough FROM pages")
def page_audit(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.contains("html", F.lit("<title>")).alias("titled"), (F.size(F.split("html", "<p>", -1)) > 3).alias("long_enough"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(len(string_split_regex(text, '[^A-Za-z]+'))) AS BIGINT) AS words FROM conversations GROUP BY conv_id")
def trace_summary(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.size(F.split("text", "[^A-Za-z]+", -1))).alias("words"))


@query(
    f"""WITH n AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(p_name), '[a-z]+|[0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({", ".join(repr(x) for x in text.LEAK_STOP)}))) AS w FROM part),
c AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x)))) AS w FROM conversations), t AS (SELECT conv_id, turn, count(*) AS told FROM c JOIN n USING (w) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(told, 0) / (SELECT count(*) FROM n), 6) AS leak FROM conversations LEFT JOIN t USING (conv_id, turn)"""
)
def leak_guard(spark, sf):
    """Conversations that give away the parts' names."""
    names = table(spark, sf, "part").select(F.explode(text.leak_tokens(F.regexp_replace("p_name", " ", "_"))).alias("word")).distinct()
    turns = table(spark, sf, "conversations").select("conv_id", "turn", text.query_words(F.col("text")).alias("words"))
    told = turns.select("conv_id", "turn", F.explode(F.array_distinct("words")).alias("word")).join(names, "word").groupBy("conv_id", "turn").agg(F.count("*").alias("told"))
    total = names.agg(F.count("*").alias("total"))  # one row
    out = turns.join(told, ["conv_id", "turn"], "left").crossJoin(F.broadcast(total))
    return out.select("conv_id", "turn", F.round(F.coalesce("told", F.lit(0)) / F.col("total"), 6).alias("leak"))
