"""Queries of selection, spans, staging, labels and other upkeep of the views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope.functions import paths
from corpuscope.operators import evaluation, facts, filters, graph, incremental, intervals, lexical, ranking
from corpuscope.plans import planner
from corpuscope.plans.queries_rank import VEC
from corpuscope.plans.queries_text import bm25_sql
from corpuscope.plans.registry import query
from corpuscope.plans.views import CANDIDATES_SQL, EDGES_SQL, FILES_SQL, VERTICES_SQL, candidates, edges, files, table, vertices
from corpuscope.session import shared_folder
from corpuscope.sources import repository
from corpuscope.streaming import commits


@query("SELECT doc_id, n, old_start, old_end, new_start, new_end FROM (SELECT doc_id, CAST(0 AS BIGINT) AS n, n_chars AS old_start, n_chars + 1 AS old_end, doc_id AS new_start, doc_id AS new_end FROM documents UNION ALL SELECT doc_id, 1, 8, 8, 10, 10 FROM documents)")
def diff_hunks(spark, sf):
    body = F.concat(F.lit("--- a\n+++ b\n@@ -"), (F.col("n_chars") + 1).cast("string"), F.lit(",2 +"), (F.col("doc_id") + 1).cast("string"), F.lit(" @@\n@@ -9 +12,0 @@\n-y"))
    return intervals.hunks(table(spark, sf, "documents").select("doc_id", body.alias("text")), key="doc_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'click') AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id ORDER BY min(event_id), user_id LIMIT 20)) WHERE n <= 3")
def query_selection(spark, sf):
    return filters.select_queries(table(spark, sf, "events"), "event_type", "user_id", "event_id", ["view", "click"], 20, 3).select("event_id")


@query(
    r"""SELECT vid, regexp_matches(lower(file), '(^|/)(test|tests|__tests__|spec|specs)/') OR regexp_matches(lower(file), '(^|/)test[^/]*$') OR regexp_matches(file, '(^|/)(dist|build|out|node_modules|vendor)/') OR regexp_matches(file, '(\.min\.js|\.d\.ts|\.map)$')
  OR regexp_matches(lower(file), '(^|/)(benchmark|benchmarks|doc|docs|eval|evaluation|example|examples|experiment|experiments|sample|samples|scripts)/') OR regexp_matches(lower(file), '\.(adoc|md|rst)$') AS supporting FROM files""",
    FILES_SQL,
)
def supporting_evidence(spark, sf):
    return files(spark, sf).select("vid", filters.is_supporting(F.col("file")).alias("supporting"))


@query(bm25_sql(["old", "widget", "anvil"]).replace("SELECT doc_id, list_transform", "SELECT vid AS doc_id, list_transform").replace("replace(text,", "replace(name,").replace("FROM documents", "FROM vertices") + "SELECT doc_id AS id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 25", VERTICES_SQL)
def bm25_graph(spark, sf):
    """Vertices as documents."""
    d = lexical.graph_documents(vertices(spark, sf))
    return lexical.bm25(d, "id", "content", ["old", "widget", "anvil"]).orderBy(F.desc("score"), "id").limit(25).select("id", F.round("score", 6).alias("score"))


@query("WITH r AS (SELECT event_id % 3 AS branch, event_id // 3 AS rank, ['load', 'save', 'Write', 'open', 'persist'][CAST(1 + event_id % 5 AS BIGINT)] AS identifier FROM events), f AS (SELECT identifier, branch, rank, row_number() OVER (PARTITION BY identifier ORDER BY branch, rank) AS n FROM r WHERE lower(identifier) IN ('save', 'persist', 'serialize', 'write')) SELECT identifier, branch, rank FROM f WHERE n = 1 ORDER BY branch, rank, identifier LIMIT 3")
def action_identifiers(spark, sf):
    i = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(f"a/b.py:Store.{x}()") for x in ("load", "save", "Write", "open", "persist")]), (1 + i % 5).cast("int"))
    rows = table(spark, sf, "events").select((i % 3).alias("branch"), F.expr("event_id div 3").alias("rank"), name.alias("name"), F.lit("x").alias("node_id"))
    return lexical.action_identifiers(rows, "how do we save the state")


@query("SELECT o_orderkey, 'f' || (o_orderkey % 50) AS file, least(a, b) + 1 AS s, greatest(a, b) + 1 AS e, coalesce(o_totalprice, 0) AS score FROM (SELECT *, o_custkey % 90 AS a, o_custkey % 70 AS b FROM orders)")
def node_spans(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("f"), (k % 50).cast("string"), F.lit(":x")).alias("node_id"), F.lit("/build/z").alias("file"), (F.col("o_custkey") % 90).alias("start_line"), (F.col("o_custkey") % 70).alias("end_line"), F.col("o_totalprice").alias("score"))
    key = o.select("o_orderkey", F.concat_ws("#", "node_id", "o_orderkey").alias("k"))
    spans = intervals.node_spans(o.withColumn("node_id", F.concat_ws("#", "node_id", "o_orderkey")))
    return spans.join(key, spans["node_id"] == key["k"]).select("o_orderkey", "file", "s", "e", "score")


@query("SELECT p_partkey, 'parts' AS file, s, e FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS leaf FROM part) JOIN (SELECT split_part(p_name, ' ', 1) AS leaf, min(p_partkey) AS s, max(p_partkey) AS e FROM part GROUP BY 1) USING (leaf)")
def symbol_spans(spark, sf):
    first = F.substring_index("p_name", " ", 1)
    p = table(spark, sf, "part")
    answers = p.select("p_partkey", F.concat(F.lit("parts:Outer."), first, F.lit("(self, x)")).alias("symbol"))
    index = p.groupBy(first.alias("leaf")).agg(F.min("p_partkey").alias("s"), F.max("p_partkey").alias("e")).withColumn("file", F.lit("parts"))
    return intervals.symbol_spans(answers, index).select("p_partkey", "file", "s", "e")


@query("SELECT p_partkey, least(p_size, 20) - 1 AS s, greatest(p_size, 20) - 1 AS e FROM part WHERE least(p_size, 20) >= 1")
def span_normalisation(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), F.lit("20").alias("b"))
    return intervals.normalize_span(p, "a", "b", 1).select("p_partkey", "s", "e")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN NULL ELSE source || '/x.py' END AS path FROM documents")
def path_normalisation(spark, sf):
    i = F.col("doc_id") % 4
    raw = F.when(i == 0, F.concat(F.lit("/"), "source")).when(i == 1, F.concat(F.lit("../"), "source")).when(i == 2, F.concat(F.lit("./"), "source", F.lit("/y/../x.py"))).otherwise(F.concat("source", F.lit("\\x.py")))
    return table(spark, sf, "documents").select("doc_id", paths.normalize(raw).alias("path"))


@query("SELECT event_id, 'src/m' || (event_id % 7) || '.py:' || event_id || ',lib/b.go' AS places FROM events")
def answer_parser(spark, sf):
    i = F.col("event_id").cast("string")
    answer = F.concat(F.lit("Locations: src/m"), (F.col("event_id") % 7).cast("string"), F.lit(".py:"), i, F.lit(" and lib/b.go, lib/b.go"))
    return table(spark, sf, "events").select("event_id", F.array_join(intervals.parse_answer(answer), ",").alias("places"))


@query("SELECT count(*) AS added, CAST(sum(eid % 1000) AS BIGINT) AS check_sum FROM (SELECT min(eid) AS eid FROM edges WHERE type <> 'contain' AND NOT (type = 'type-use') GROUP BY src, dst, type, anchor_file, anchor_line)", EDGES_SQL)
def edge_staging(spark, sf):
    """One flush of all edges but those of containment, where the uses of types are known already."""
    e = edges(spark, sf)
    staged = e.filter("type <> 'contain'")
    new = incremental.stage_edges(e.filter("type = 'type-use'"), staged.unionByName(staged), ["src", "dst", "type", "anchor_file", "anchor_line"], "eid")
    return new.agg(F.count("*").alias("added"), F.sum(F.col("eid") % 1000).alias("check_sum"))


@query(
    """WITH t AS (SELECT vid FROM vertices WHERE type = 'nation' AND vid % 5 = 0), n AS (SELECT dst AS vid, 'target' AS why FROM edges WHERE src IN (SELECT vid FROM t) UNION SELECT src, 'source' FROM edges WHERE dst IN (SELECT vid FROM t))
SELECT vid, 'changed' AS why FROM t UNION ALL SELECT vid, min(why) FROM n WHERE vid NOT IN (SELECT vid FROM t) GROUP BY vid""",
    VERTICES_SQL, EDGES_SQL,
)
def affected_symbols(spark, sf):
    v = vertices(spark, sf).filter("type = 'nation'").select("vid", F.lit("world").alias("file"), (F.col("vid") % 5 * 10).alias("s"), (F.col("vid") % 5 * 10 + 4).alias("e"))
    hunk = v.select("file").distinct().select("file", F.lit(0).cast("long").alias("s"), F.lit(3).cast("long").alias("e"))
    return incremental.affected_symbols(v, hunk, edges(spark, sf))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def verified_updates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return incremental.admit(o, "verified", o.filter("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey")


@query(
    """WITH p AS (SELECT DISTINCT user_id % 50 AS q, event_type AS item FROM events WHERE event_id % 3 = 0 AND user_id % 50 <> 7), t AS (SELECT DISTINCT user_id % 50 AS q, event_type AS item FROM events WHERE event_id % 11 = 0), i AS (SELECT DISTINCT user_id % 50 AS q FROM events),
s AS (SELECT q, (SELECT count(*) FROM p WHERE p.q = i.q) AS named, (SELECT count(*) FROM t WHERE t.q = i.q) AS n, (SELECT count(*) FROM p JOIN t USING (q, item) WHERE p.q = i.q) AS hit FROM i)
SELECT count(*) AS n, count(*) FILTER (WHERE hit = s.n) AS matches, round(avg(CASE WHEN hit = s.n THEN 1.0 ELSE 0.0 END), 9) AS match_rate, round(avg(CASE WHEN named > 0 THEN hit / named ELSE 1.0 END), 9) AS precision_mean FROM s"""
)
def location_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("q"), F.col("event_type").alias("item"), "event_id")
    scores = evaluation.location_scores(e.filter("event_id % 3 = 0 and q <> 7"), e.filter("event_id % 11 = 0"), e, "q", "item")
    return evaluation.location_summary(scores).select("n", "matches", F.round("match_rate", 9).alias("match_rate"), F.round("precision_mean", 9).alias("precision_mean"))


@query()
def nested_bootstrap(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("repo"), F.col("user_id").alias("instance"), "event_id", "value")
    return evaluation.nested_bootstrap(e, ["repo", "instance"], "value", 50)


@query(
    """WITH p AS (SELECT DISTINCT file, string_split(file, '/') AS x FROM files), n AS (SELECT array_to_string(x[1:i], '/') AS path, i - 1 AS depth, max(i < len(x)) AS folder FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM p) GROUP BY 1, 2)
SELECT path, CAST(depth AS INT) AS depth, repeat('  ', depth) || string_split(path, '/')[-1] || CASE WHEN folder THEN '/' ELSE '' END AS line FROM n""",
    FILES_SQL,
)
def file_tree(spark, sf):
    return graph.file_tree(files(spark, sf))


@query("SELECT eid, CASE WHEN src % 2 = 0 THEN 'label ' || (eid % 100) END AS label FROM edges WHERE type = 'contain'", EDGES_SQL)
def edge_labels(spark, sf):
    e = edges(spark, sf).filter("type = 'contain'")
    keyed = graph.edge_labels(e, spark.createDataFrame([], "label_key string, label string"), ["src", "dst", "type"])
    cache = keyed.filter("src % 2 = 0").select("label_key", F.concat(F.lit("label "), (F.col("eid") % 100).cast("string")).alias("label"))
    return graph.edge_labels(e, cache, ["src", "dst", "type"]).select("eid", "label")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 2 = 0 AS resolved FROM lineitem")
def resolve_in_file(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("file"), F.col("l_partkey").alias("symbol_id"))
    return facts.resolve_in_file(line, line.filter("symbol_id % 2 = 0")).select("l_orderkey", "l_linenumber", "resolved")


@query("SELECT count(*) AS live, (SELECT count(*) FROM embeddings WHERE vec_id % 10 IN (SELECT doc_id % 7 FROM documents)) AS kept FROM (SELECT DISTINCT doc_id % 7 FROM documents)")
def cache_prune(spark, sf):
    live = incremental.live_hashes(table(spark, sf, "documents").select((F.col("doc_id") % 7).alias("content_hash")))
    cache = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("content_hash"), "embedding")
    return live.agg(F.count("*").alias("live")).crossJoin(incremental.cache_prune(cache, live).agg(F.count("*").alias("kept")))


@query("SELECT count(DISTINCT text) AS payloads, count(DISTINCT left(sha256(text), 2)) AS shards FROM documents")
def payload_store(spark, sf):
    """Distinct payloads stored by their digest; storing them again adds none."""
    path = f"{shared_folder(spark)}/views/payloads-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select(F.col("text").alias("content"))
    repository.put_payloads(d, path)
    repository.put_payloads(d, path)
    return spark.read.parquet(path).agg(F.count("sha").alias("payloads"), F.count_distinct("shard").alias("shards"))


@query("SELECT type, count(*) AS n FROM vertices GROUP BY type", VERTICES_SQL)
def graph_store(spark, sf):
    """Vertices written as a view, read back."""
    path = f"{shared_folder(spark)}/views/vertices-{uuid.uuid4().hex}"
    repository.write_view(vertices(spark, sf), path, "type")
    return spark.read.parquet(path).groupBy("type").agg(F.count("*").alias("n"))


@query(
    f"""WITH h AS (SELECT e.vec_id + 3000000000 AS vid, {VEC} AS score, row_number() OVER (ORDER BY {VEC} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), seed AS (SELECT * FROM h WHERE rank <= 8),
m AS (SELECT s.vid AS seed, s.rank, x.src AS t, min(x.eid) AS eid FROM seed s JOIN edges x ON x.dst = s.vid WHERE type = 'reference' GROUP BY ALL), k AS (SELECT t AS vid, rank * 1000 + n AS place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY eid, t) AS n FROM m) WHERE n <= 3),
every AS (SELECT vid, 0 AS tier, rank AS place FROM seed UNION ALL SELECT vid, 1, min(place) FROM k GROUP BY vid), one AS (SELECT vid, min(tier * 10000000 + place) AS place FROM every WHERE vid IN (SELECT vid FROM vertices) GROUP BY vid)
SELECT CAST(vid AS BIGINT) AS id FROM (SELECT one.vid, score, place FROM one LEFT JOIN h USING (vid) ORDER BY score IS NULL, score DESC, place, vid LIMIT 20)""",
    EDGES_SQL, VERTICES_SQL,
)
def dense_graph_search(spark, sf):
    """Parts near a vector, what refers to them, reranked."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") + 3000000000).alias("vec_id"), "embedding")
    return planner.dense_graph_search(e, e.filter("vec_id = 3000000000"), edges(spark, sf), vertices(spark, sf), 20, 8, 3).select("id")


@query("SELECT event_type, arg_max(user_id, event_id) AS newest, max(event_id) AS seq FROM events WHERE event_id <= (SELECT median(event_id) FROM events) GROUP BY event_type")
def snapshot_at(spark, sf):
    """The view as of a change: what a key was then."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("user_id").alias("value"), F.lit(False).alias("deleted"))
    then = e.agg(F.median("seq").alias("then"))  # one row
    past = e.crossJoin(F.broadcast(then)).filter(F.col("seq") <= F.col("then")).drop("then")
    return facts.overlay(past, "key", "seq").select(F.col("key").alias("event_type"), F.col("value").alias("newest"), "seq")


@query("SELECT CAST(unnest([0, 1]) AS INT) AS step, CAST(unnest([c, 4000000007]) AS BIGINT) AS vid FROM (SELECT 1000000000 + o_custkey AS c FROM orders WHERE o_orderkey = 7)")
def trace_path(spark, sf):
    """From a customer back to one of their orders."""
    row = table(spark, sf, "orders").filter("o_orderkey = 7").first()
    return graph.trace(edges(spark, sf), 1000000000 + row.o_custkey, 4000000007, 3)


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_activity(spark, sf):
    """The streaming aggregate over a bounded input: events by type and day."""
    w = commits.windowed_activity(table(spark, sf, "events"))
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT p_partkey, 'parts.py:' || p_brand || '.go()' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'class ' || p_brand || ':' || chr(10) ELSE '' END || p_name AS content FROM part")
def chunk_prefix(spark, sf):
    """Chunks as they are indexed: their id, the class of a method, the content."""
    name = F.concat("p_brand", F.lit(".go"))
    kind = F.when(F.col("p_size") % 2 == 0, "method").otherwise("function")
    c = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("parts.py:"), name, F.lit("()")).alias("node_id"), name.alias("name"), kind.alias("chunk_type"), F.col("p_name").alias("content"))
    return repository.with_prefix(c).select("p_partkey", "content")


@query(
    """SELECT vid, CASE WHEN vid % 3 = 0 THEN file || ':1:9' ELSE file || ':f' END AS node, file AS path FROM files""",
    FILES_SQL,
)
def result_keys(spark, sf):
    """What tells results apart: their id, else their span; and the path that their id or file gives."""
    f = files(spark, sf)
    node = F.when(F.col("vid") % 3 != 0, F.concat("file", F.lit(":f")))
    own = f.select("vid", "file", node.alias("node_id"), F.concat(F.lit("/build/"), "file").alias("built"))
    key = ranking.node_key(F.col("node_id"), F.col("file"), F.lit(1), F.lit(9))
    return own.select("vid", key.alias("node"), ranking.file_key(F.coalesce("node_id", F.concat("file", F.lit(":x"))), F.col("built")).alias("path"))


@query("SELECT l_partkey, l_linenumber, min(l_orderkey) AS first_order FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL")
def distinct_chunks(spark, sf):
    line = table(spark, sf, "lineitem").groupBy("l_partkey", "l_linenumber", "l_orderkey").agg(F.lit(1).alias("one"))
    p = F.col("l_partkey")
    rows = line.select("l_partkey", "l_linenumber", "l_orderkey", F.when(p % 5 != 0, p.cast("string")).alias("node_id"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.col("l_orderkey").alias("position"))
    return lexical.distinct_chunks(rows).select("l_partkey", "l_linenumber", F.col("l_orderkey").alias("first_order"))


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'renamed' WHEN event_id % 3 = 0 THEN 'added' ELSE 'modified' END AS status, event_type || '.py' AS file, CASE WHEN event_id % 8 = 0 THEN 'old.go' END AS old_file FROM events")
def renamed_files(spark, sf):
    i = F.col("event_id")
    status = F.when(i % 8 == 0, "R090").when(i % 3 == 0, "A").otherwise("M")
    e = table(spark, sf, "events").select(i.alias("commit"), status.alias("status"), F.concat("event_type", F.lit(".py")).alias("path"), F.lit("old.go").alias("old_path"))
    return incremental.renamed_files(e, [".py"]).withColumnRenamed("commit", "event_id")


@query("SELECT DISTINCT file, CASE WHEN vid % 4 = 0 THEN 'tracked' WHEN file LIKE 'src1/%' OR file LIKE 'src2/tests/%' THEN 'submodule' ELSE 'outside' END AS class FROM files", FILES_SQL)
def surface_classes(spark, sf):
    f = files(spark, sf)
    roots = spark.createDataFrame([("src1",), ("src2/tests",)], "file string")
    return incremental.surface_classes(f, f.filter("vid % 4 = 0"), roots)


@query("SELECT count(*) FILTER (WHERE doc_id % 10 = 0) AS missing, CAST(0 AS BIGINT) AS extra, count(*) FILTER (WHERE doc_id % 10 = 0) = 0 AS converged FROM documents")
def convergence(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return incremental.convergence(d.filter("doc_id % 10 <> 0"), d, ["doc_id", "h"])


@query(
    """WITH v AS (SELECT *, vid % 100 AS a, vid % 100 + 5 AS b FROM vertices), s AS (SELECT DISTINCT file, a, b FROM v WHERE name = 'NATION_3'), d AS (SELECT DISTINCT v.vid FROM v JOIN s ON v.file = s.file AND v.a <= s.b AND v.b >= s.a)
SELECT 'defined' AS role, CAST(vid AS BIGINT) AS id FROM d UNION ALL SELECT 'incoming', CAST(eid AS BIGINT) FROM edges WHERE src <> dst AND dst IN (SELECT vid FROM d)""",
    VERTICES_SQL, EDGES_SQL,
)
def range_query_by_symbol(spark, sf):
    v = vertices(spark, sf).withColumn("start_line", F.col("vid") % 100).withColumn("end_line", F.col("vid") % 100 + 5)
    return graph.range_query_by_symbol(v, edges(spark, sf).withColumn("anchor_file", F.col("anchor_file").cast("string")), "NATION_3")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN source || '/x.py:A.f()' WHEN 2 THEN NULL ELSE NULL END AS symbol FROM documents")
def symbol_normalisation(spark, sf):
    i = F.col("doc_id") % 4
    raw = F.when(i == 0, "plain").when(i == 1, F.concat(F.lit("./"), "source", F.lit("//x.py:A.f()"))).when(i == 2, F.lit("C:x.py:f")).otherwise(F.concat(F.lit("../"), "source", F.lit(":f")))
    return table(spark, sf, "documents").select("doc_id", paths.normalize_symbol(raw).alias("symbol"))


@query("WITH w AS (SELECT node_id, CASE branch WHEN 0 THEN 0.7 ELSE 0.3 END / (60 + rank) AS s FROM candidates WHERE branch < 2) SELECT node_id, round(sum(s), 9) AS score FROM w GROUP BY node_id", CANDIDATES_SQL)
def stage_fusion(spark, sf):
    c = candidates(spark, sf)
    stages = [(n, c.filter(F.col("branch") == b)) for n, b in (("dense", 0), ("sparse", 1))]
    return ranking.run_stages(stages, "node_id", 1000, "rrf", [0.7, 0.3]).select("node_id", F.round("score", 9).alias("score"))
