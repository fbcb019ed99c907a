"""Queries of the evaluation, fact, incremental, catalog and planner operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import catalog, evaluation, facts, filters, incremental, ranking
from corpuscope.plans import planner
from corpuscope.plans.queries_rank import VEC
from corpuscope.plans.queries_text import bm25_sql
from corpuscope.plans.registry import query
from corpuscope.plans.views import CELLS_SQL, EDGES_SQL, FILES_SQL, cells, edges, files, table
from corpuscope.sources import repository

PRED = """pred AS (SELECT doc_id % 40 AS q, source AS item, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
truth AS (SELECT DISTINCT doc_id % 40 AS q, source AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 3 = 0), ks AS (SELECT unnest([1, 5, 10]) AS k)"""


def _pred(spark, sf):
    from pyspark.sql import Window as W

    d = table(spark, sf, "documents")
    p = d.select((F.col("doc_id") % 40).alias("q"), F.col("source").alias("item"), F.row_number().over(W.partitionBy(F.col("doc_id") % 40).orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    t = d.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").filter("doc_id % 3 = 0").select((F.col("doc_id") % 40).alias("q"), F.col("source").alias("item")).distinct()
    return p, t


METRICS_SQL = """WITH o AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY min(rank), item) AS rank FROM pred GROUP BY q, item),
h AS (SELECT q, k, count(DISTINCT item) AS hits FROM o JOIN truth USING (q, item), ks WHERE rank <= k GROUP BY ALL), g AS (SELECT q, k, count(*) AS given FROM o, ks WHERE rank <= k GROUP BY ALL), b AS (SELECT q, k, count(*) AS n FROM truth, ks GROUP BY ALL),
m AS (SELECT b.q, CAST(b.k AS INT) AS k, CAST(coalesce(hits, 0) = n AS BIGINT) AS accuracy, coalesce(hits, 0) / greatest(coalesce(given, 0), 1) AS "precision", coalesce(hits, 0) / n AS recall FROM b LEFT JOIN h USING (q, k) LEFT JOIN g USING (q, k)) """


@query(METRICS_SQL + 'SELECT q, k, accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM m', PRED)
def retrieval_metrics_at_k(spark, sf):
    p, t = _pred(spark, sf)
    m = evaluation.metrics_at_k(p, t, "q", "item", [1, 5, 10])
    return m.select("q", "k", "accuracy", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(METRICS_SQL + 'SELECT k, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, count(*) AS n FROM m GROUP BY k', PRED)
def mean_metrics(spark, sf):
    p, t = _pred(spark, sf)
    m = evaluation.mean_metrics(evaluation.metrics_at_k(p, t, "q", "item", [1, 5, 10]), ["k"], ["precision", "recall"])
    return m.select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "n")


@query("SELECT arm, query_id, round(avg(recall), 9) AS recall, min(cost) AS cost, min(turns) AS turns, count(*) AS reps FROM cells WHERE success GROUP BY arm, query_id", CELLS_SQL)
def rep_fold(spark, sf):
    return evaluation.fold_repetitions(cells(spark, sf), ["arm", "query_id"]).withColumn("recall", F.round("recall", 9))


ARMS_SQL = "a AS (SELECT arm, count(*) AS n, avg(CAST(success AS DOUBLE)) AS success_rate, avg(cost) FILTER (WHERE success) AS mean_cost_success, count(*) FILTER (WHERE NOT success) AS failures, quantile_cont(cost, 0.5) AS median_cost FROM cells GROUP BY arm)"


@query("SELECT arm, n, round(success_rate, 9) AS success_rate, round(mean_cost_success, 6) AS mean_cost_success, failures, round(median_cost, 6) AS median_cost FROM a", CELLS_SQL, ARMS_SQL)
def arm_summary(spark, sf):
    a = evaluation.arm_summary(cells(spark, sf), "arm")
    return a.select("arm", "n", F.round("success_rate", 9).alias("success_rate"), F.round("mean_cost_success", 6).alias("mean_cost_success"), "failures", F.round("median_cost", 6).alias("median_cost"))


@query("SELECT a.arm, round(a.success_rate - b.success_rate, 9) AS delta_success_rate, round(a.median_cost - b.median_cost, 6) AS delta_median_cost FROM a, a b WHERE b.arm = 'view'", CELLS_SQL, ARMS_SQL)
def baseline_deltas(spark, sf):
    d = evaluation.baseline_deltas(evaluation.arm_summary(cells(spark, sf), "arm"), "arm", "view", ["success_rate", "median_cost"])
    return d.select("arm", F.round("delta_success_rate", 9).alias("delta_success_rate"), F.round("delta_median_cost", 6).alias("delta_median_cost"))


PAIR_SQL = "f AS (SELECT arm, query_id, avg(recall) AS recall FROM cells WHERE success GROUP BY ALL), p AS (SELECT x.query_id, x.recall AS a, y.recall AS b FROM f x JOIN f y ON x.query_id = y.query_id AND x.arm = 'view' AND y.arm = 'click')"


def _pairs(spark, sf):
    f = evaluation.fold_repetitions(cells(spark, sf), ["arm", "query_id"])
    return evaluation.paired(f, "arm", "view", "click", ["query_id"], "recall")


@query(
    """SELECT coalesce(CAST(g AS VARCHAR), 'ALL') AS category, CAST(count(*) FILTER (WHERE b - a > 1e-9) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE abs(b - a) <= 1e-9) AS BIGINT) AS ties, CAST(count(*) FILTER (WHERE b - a < -1e-9) AS BIGINT) AS losses, round(avg(b - a), 9) AS mean_delta
FROM (SELECT *, query_id % 3 AS g FROM p) GROUP BY ROLLUP (g)""",
    CELLS_SQL, PAIR_SQL,
)
def win_tie_loss(spark, sf):
    p = _pairs(spark, sf).withColumn("category", (F.col("query_id") % 3).cast("string"))
    return evaluation.verdict(p, "category").withColumn("mean_delta", F.round("mean_delta", 9))


@query()
def paired_bootstrap(spark, sf):
    return evaluation.non_inferior(evaluation.bootstrap(_pairs(spark, sf).withColumn("delta", F.col("b") - F.col("a")), "query_id", "delta", 200), 0.05)


@query()
def clustered_bootstrap(spark, sf):
    p = _pairs(spark, sf).withColumn("delta", F.col("b") - F.col("a")).withColumn("repo", F.col("query_id") % 12)
    return evaluation.bootstrap(p, "query_id", "delta", 100, cluster="repo")


@query("SELECT p_partkey, p_size, p_retailprice FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE (y.p_size >= x.p_size AND y.p_retailprice < x.p_retailprice) OR (y.p_size > x.p_size AND y.p_retailprice <= x.p_retailprice))")
def pareto_front(spark, sf):
    return evaluation.pareto_front(table(spark, sf, "part"), "p_size", "p_retailprice", "p_partkey")


@query("WITH q AS (SELECT arm, avg(recall) AS recall, sum(cost) AS cost FROM cells GROUP BY arm) SELECT arg_min(arm, cost) AS arm, round(min(cost), 6) AS cost, round(min(cost) / max(cost), 9) AS ratio FROM q WHERE recall >= 0.49", CELLS_SQL)
def constrained_optimum(spark, sf):
    q = cells(spark, sf).groupBy("arm").agg(F.avg("recall").alias("recall"), F.sum("cost").alias("cost"))
    o = evaluation.constrained_optimum(q, "recall", 0.49, "cost", "arm")
    return o.select("arm", F.round("cost", 6).alias("cost"), F.round("ratio", 9).alias("ratio"))


@query(
    """SELECT arm, CAST(sum(prompt) AS BIGINT) AS sum_prompt, round(count(prompt) / count(*), 9) AS coverage_prompt, CASE WHEN count(prompt) = count(*) THEN CAST(sum(prompt) AS BIGINT) END AS total_prompt, CAST(sum(completion) AS BIGINT) AS sum_completion,
round(count(completion) / count(*), 9) AS coverage_completion, CASE WHEN count(completion) = count(*) THEN CAST(sum(completion) AS BIGINT) END AS total_completion FROM cells GROUP BY arm""",
    CELLS_SQL,
)
def token_coverage(spark, sf):
    t = evaluation.token_accounting(cells(spark, sf), "arm", ["prompt", "completion"])
    return t.withColumn("coverage_prompt", F.round("coverage_prompt", 9)).withColumn("coverage_completion", F.round("coverage_completion", 9))


@query(
    """SELECT rep, round((greatest(prompt - completion, 0) * 3.0 + completion * 0.3 + completion * 15.0) / 1e6, 9) AS cost FROM cells WHERE arm = 'view' UNION ALL SELECT rep, CAST(NULL AS DOUBLE) FROM cells WHERE arm = 'click'""", CELLS_SQL
)
def price_projection(spark, sf):
    rates = spark.sql("SELECT 'view' AS arm, 3.0D AS rate_input, 0.3D AS rate_cached, 15.0D AS rate_output")
    c = cells(spark, sf).filter("arm in ('view', 'click')").drop("cost").withColumn("cached", F.col("completion")).withColumn("prompt_includes_cache", F.lit(True))
    return evaluation.price(c, rates, "arm").select("rep", F.round("cost", 9).alias("cost"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def percentile_profile(spark, sf):
    p = evaluation.profile(table(spark, sf, "events"), "event_type", "value")
    return p.select("event_type", "n", F.round("total", 4).alias("total"), "least", "most", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "std")])


@query("SELECT user_id, list_sort(list(value))[CAST(least(floor(0.9 * count(*)) + 1, count(*)) AS BIGINT)] AS p90 FROM events GROUP BY user_id")
def index_percentile(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(evaluation.index_percentile(F.collect_list("value"), 0.9).alias("p90"))


@query("SELECT arg_min(value, event_id) AS cold, round(avg(value) FILTER (WHERE event_id > 0), 6) AS patched, round(arg_min(value, event_id) / avg(value) FILTER (WHERE event_id > 0), 6) AS speedup FROM events")
def commit_window_stats(spark, sf):
    w = evaluation.commit_window(table(spark, sf, "events"), "event_id", "value")
    return w.select("cold", F.round("patched", 6).alias("patched"), F.round("speedup", 6).alias("speedup"))


@query(
    """SELECT user_id % 10 AS session, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS equivalent, round(quantile_cont(value, 0.5) FILTER (WHERE event_type = 'view'), 6) AS static_p50, round(quantile_cont(value * 4, 0.5) FILTER (WHERE event_type = 'view'), 6) AS live_p50 FROM events GROUP BY 1"""
)
def replay_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("session"), F.when(F.col("event_type") == "view", "equivalent").otherwise("other").alias("status"), F.col("value").alias("static_ms"), (F.col("value") * 4).alias("live_ms"))
    r = evaluation.replay_summary(e, "session")
    return r.withColumn("static_p50", F.round("static_p50", 6)).withColumn("live_p50", F.round("live_p50", 6))


@query("SELECT event_id, round(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 - epoch_us(ts) / 1e6, 3) AS next_latency FROM events")
def trace_next_latency(spark, sf):
    t = evaluation.trace_latency(table(spark, sf, "events"), "user_id", "event_id", "ts")
    return t.select("event_id", F.round("next_latency", 3).alias("next_latency"))


@query(
    """WITH v AS (SELECT DISTINCT user_id % 20 AS q, event_id % 5 AS run, CAST(value AS BIGINT) AS block FROM events WHERE event_id % 3 = 0), n AS (SELECT q, block, count(*) AS votes FROM v GROUP BY ALL), r AS (SELECT q, count(DISTINCT run) AS runs FROM v GROUP BY q)
SELECT q, block, votes FROM n JOIN r USING (q) WHERE votes >= ceil(runs / 2)"""
)
def consensus_blocks(spark, sf):
    return evaluation.consensus(_votes(spark, sf), "q", "run", "block")


def _votes(spark, sf):
    return table(spark, sf, "events").filter("event_id % 3 = 0").select((F.col("user_id") % 20).alias("q"), (F.col("event_id") % 5).alias("run"), F.rint("value").cast("long").alias("block"))


@query(
    """WITH v AS (SELECT DISTINCT user_id % 20 AS q, event_id % 5 AS run, CAST(value AS BIGINT) AS block FROM events WHERE event_id % 3 = 0), n AS (SELECT q, block, count(*) AS votes FROM v GROUP BY ALL), t AS (SELECT q, run, sum(votes) AS total FROM v JOIN n USING (q, block) GROUP BY ALL)
SELECT q, arg_min(run, -total * 100 + run) AS run, CAST(max(total) AS BIGINT) AS total FROM t GROUP BY q"""
)
def best_run(spark, sf):
    return evaluation.best_run(_votes(spark, sf), "q", "run", "block")


@query("SELECT unnest(['pages', 'long_pages']) AS \"check\", unnest([CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (WHERE length(html) > 2000) AS DOUBLE)]) AS value, unnest([10.0::DOUBLE, 100000.0::DOUBLE]) AS minimum, unnest([count(*) >= 10, count(*) FILTER (WHERE length(html) > 2000) >= 100000]) AS passed FROM pages")
def quality_gate(spark, sf):
    p = table(spark, sf, "pages").select(F.lit(1).alias("pages"), (F.length("html") > 2000).cast("int").alias("long_pages"))
    return evaluation.gate(p, {"pages": 10, "long_pages": 100000})


DEFS_SQL = """defs AS (SELECT p_partkey AS symbol_id, p_brand AS file, CASE WHEN p_partkey % 5 = 0 THEN 'local ' ELSE '' END || p_name || CAST(p_size AS VARCHAR) AS moniker FROM part),
uses AS (SELECT DISTINCT l_partkey * 1000 + l_suppkey AS eid, p_brand AS file, CASE WHEN p_partkey % 5 = 0 THEN 'local ' ELSE '' END || p_name || CAST(p_size AS VARCHAR) AS moniker FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey < 10)"""


def _facts(spark, sf):
    p = table(spark, sf, "part")
    moniker = F.concat(F.when(F.col("p_partkey") % 5 == 0, "local ").otherwise(""), "p_name", F.col("p_size").cast("string")).alias("moniker")
    defs = p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file"), moniker)
    uses = table(spark, sf, "lineitem").filter("l_suppkey < 10").join(p, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("eid"), F.col("p_brand").alias("file"), moniker).distinct()
    return defs, uses


MONIKER_SQL = """WITH d AS (SELECT CASE WHEN moniker LIKE 'local %' THEN file ELSE '' END AS sc, moniker, count(*) AS n, min(symbol_id) AS target FROM defs GROUP BY ALL), r AS (SELECT eid, u.moniker, target FROM uses u LEFT JOIN (SELECT * FROM d WHERE n = 1) d ON u.moniker = d.moniker AND sc = CASE WHEN u.moniker LIKE 'local %' THEN u.file ELSE '' END) """


@query(MONIKER_SQL + "SELECT eid, moniker, target FROM r", DEFS_SQL)
def moniker_resolve(spark, sf):
    defs, uses = _facts(spark, sf)
    return facts.resolve_monikers(uses, defs).select("eid", "moniker", "target")


@query(MONIKER_SQL + "SELECT count(*) AS edges, count(target) AS resolved, count(*) - count(target) AS unresolved FROM r", DEFS_SQL)
def resolver_report(spark, sf):
    defs, uses = _facts(spark, sf)
    return facts.resolver_report(uses, facts.resolve_monikers(uses, defs))


@query("WITH o AS (SELECT moniker, min(symbol_id) AS id FROM defs GROUP BY moniker HAVING count(*) = 1), r AS (SELECT DISTINCT a.moniker AS s, b.moniker AS t FROM defs a JOIN defs b ON b.symbol_id = a.symbol_id + 7) SELECT x.id AS source, y.id AS target FROM r JOIN o x ON r.s = x.moniker JOIN o y ON r.t = y.moniker", DEFS_SQL)
def rule_synthesis(spark, sf):
    defs, _ = _facts(spark, sf)
    b = defs.select((F.col("symbol_id") - 7).alias("symbol_id"), F.col("moniker").alias("target_moniker"))
    rules = defs.select("symbol_id", F.col("moniker").alias("source_moniker")).join(b, "symbol_id").select("source_moniker", "target_moniker").distinct()
    return facts.synthesize(rules, defs).select("source", "target")


@query("SELECT file, count(DISTINCT moniker) AS n_facts, sha256(string_agg(DISTINCT moniker, chr(10) ORDER BY moniker)) AS digest FROM defs GROUP BY file", DEFS_SQL)
def fact_merge(spark, sf):
    return facts.merge_batches(_facts(spark, sf)[0].withColumnRenamed("moniker", "fact"))


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS seq FROM events GROUP BY user_id) SELECT user_id, seq, t AS event_type FROM l WHERE t <> 'error'")
def fact_overlay(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", (F.col("event_type") == "error").alias("deleted"))
    return facts.overlay(e, "user_id", "seq").select("user_id", "seq", "event_type")


@query(
    """WITH a AS (SELECT vid, md5(content) AS h FROM files WHERE vid % 4 <> 0), b AS (SELECT vid, CASE WHEN vid % 10 = 1 THEN 'x' ELSE md5(content) END AS h FROM files WHERE vid % 7 <> 0)
SELECT coalesce(a.vid, b.vid) AS vid, CASE WHEN b.vid IS NULL THEN 'missing' WHEN a.vid IS NULL THEN 'extra' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.vid = b.vid WHERE a.h IS DISTINCT FROM b.h""",
    FILES_SQL,
)
def snapshot_diff(spark, sf):
    f = files(spark, sf).select("vid", F.md5("content").alias("h"))
    return facts.snapshot_diff(f.filter("vid % 4 <> 0"), f.filter("vid % 7 <> 0").withColumn("h", F.when(F.col("vid") % 10 == 1, "x").otherwise(F.col("h"))), "vid", "h")


@query(
    """WITH o AS (SELECT p_brand AS file, p_partkey AS name, p_partkey % 500 AS s, p_partkey % 500 + p_size AS e FROM part WHERE p_partkey % 9 <> 0), n AS (SELECT p_brand AS file, p_partkey AS name, p_partkey % 500 + p_partkey % 3 AS s, p_partkey % 500 + p_size + p_partkey % 3 AS e FROM part WHERE p_partkey % 8 <> 0),
h AS (SELECT DISTINCT p_brand AS file, s_suppkey * 10 AS hs, s_suppkey * 10 + 1 AS he FROM part, supplier WHERE s_suppkey < 30), m AS (SELECT DISTINCT o.file, name FROM o JOIN h ON o.file = h.file AND s <= he AND hs <= e)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.s IS NULL THEN 'deleted' WHEN o.s IS NULL THEN 'added' WHEN m.name IS NOT NULL THEN 'affected' WHEN o.s <> n.s THEN 'shifted' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.file = n.file AND o.name = n.name LEFT JOIN m ON coalesce(o.name, n.name) = m.name"""
)
def symbol_classification(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    old = p.filter(k % 9 != 0).select(F.col("p_brand").alias("file"), k.alias("name"), (k % 500).alias("s"), (k % 500 + F.col("p_size")).alias("e"))
    new = p.filter(k % 8 != 0).select(F.col("p_brand").alias("file"), k.alias("name"), (k % 500 + k % 3).alias("s"), (k % 500 + F.col("p_size") + k % 3).alias("e"))
    spots = F.explode(F.sequence(F.lit(0), F.least(F.lit(29), F.lit(29)))).alias("i")
    hunks = p.select(F.col("p_brand").alias("file")).distinct().select("file", spots).join(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("i")), "i").select("file", (F.col("i") * 10).alias("hs"), (F.col("i") * 10 + 1).alias("he"))
    return facts.symbol_diff(old, new, hunks).select("name", "state")


@query(
    """WITH o AS (SELECT DISTINCT source AS file, doc_id % 2 AS lvl, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT DISTINCT source AS file, doc_id % 2 AS lvl, md5(text) AS h FROM documents WHERE doc_id % 6 <> 0)
SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"""
)
def chunk_delta(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"), (F.col("doc_id") % 2).alias("level"), F.md5("text").alias("content_hash"))
    return incremental.chunk_delta(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 6 <> 0")).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT doc_id % 700 AS content_hash, count(v) > 0 AS hit FROM documents LEFT JOIN (SELECT vec_id AS v FROM embeddings) ON doc_id % 700 = v GROUP BY 1")
def embedding_cache_partition(spark, sf):
    wanted = table(spark, sf, "documents").select((F.col("doc_id") % 700).alias("content_hash")).distinct()
    cache = table(spark, sf, "embeddings").select(F.col("vec_id").alias("content_hash"), "embedding")
    return incremental.cache_partition(wanted, cache).select("content_hash", "hit")


@query(
    """WITH o AS (SELECT DISTINCT doc_id % 900 AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT DISTINCT doc_id % 900 AS h FROM documents WHERE doc_id % 6 <> 0), a AS (SELECT * FROM n EXCEPT SELECT * FROM o), r AS (SELECT * FROM o EXCEPT SELECT * FROM n)
SELECT (SELECT count(*) FROM a) AS added, (SELECT count(*) FROM r) AS removed, (SELECT count(*) FROM a WHERE h IN (SELECT vec_id FROM embeddings)) AS cache_hits, (SELECT count(*) FROM a) AS to_embed, round((SELECT count(*) FROM a WHERE h IN (SELECT vec_id FROM embeddings)) / (SELECT count(*) FROM a), 9) AS hit_rate"""
)
def update_counters(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 900).alias("content_hash"))
    delta = incremental.chunk_delta(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 6 <> 0"), ["content_hash"])
    cache = table(spark, sf, "embeddings").select(F.col("vec_id").alias("content_hash"), "embedding")
    return incremental.update_counters(delta, cache).withColumn("hit_rate", F.round("hit_rate", 9))


@query("SELECT p_partkey AS name, p_partkey % 500 + CASE WHEN p_partkey % 500 > 100 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 500 > 300 THEN -2 ELSE 0 END AS s FROM part")
def shift_spans(spark, sf):
    p = table(spark, sf, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("name"), (F.col("p_partkey") % 500).alias("s"), (F.col("p_partkey") % 500 + 3).alias("e"))
    shifts = spark.sql("SELECT 'f' AS file, after, delta FROM VALUES (100L, 5L), (300L, -2L) AS t(after, delta)")
    return incremental.shift_spans(p, shifts).select("name", "s")


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 2 ELSE 1 END AS changes FROM events")
def git_changes(spark, sf):
    i = F.col("event_id")
    status = table(spark, sf, "events").select(i.cast("string").alias("commit"), F.when(i % 8 == 0, "R100").when(i % 3 == 0, "A").otherwise("M").alias("status"), F.col("event_type").alias("path"), F.lit("old").alias("old_path"))
    return incremental.file_changes(status).groupBy(F.col("commit").cast("long").alias("event_id")).agg(F.count("*").cast("int").alias("changes"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size % 4 = 0) AS reuse, count(*) FILTER (WHERE p_size % 4 <> 0) AS write FROM part GROUP BY p_brand")
def publish_reuse(spark, sf):
    p = table(spark, sf, "part").withColumn("reuse_key", F.col("p_size"))
    plan = incremental.publish_plan(p, p.filter("p_size % 4 = 0").select("reuse_key"))
    return plan.groupBy("p_brand").agg(F.count_if(F.col("action") == "reuse").alias("reuse"), F.count_if(F.col("action") == "write").alias("write"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS view, CASE WHEN s_suppkey % 4 = 0 THEN 'missing' WHEN s_suppkey % 5 = 0 THEN 'failed' WHEN s_suppkey % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM supplier")
def manifest_states(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    base = [k.cast("string").alias("view"), F.lit("c1").alias("commit"), F.lit("b1").alias("builder")]
    current = s.select(*base, F.lit("f1").alias("fingerprint"))
    entries = s.filter(k % 4 != 0).select(*base, F.when(k % 3 == 0, "f0").otherwise("f1").alias("fingerprint"), (k % 5 == 0).alias("failed"))
    return incremental.manifest_states(entries, current)


@query("SELECT o_orderkey AS snapshot_id, c_name AS generation, n_name AS profile, r_name AS object FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def manifest_join(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("generation_id"))
    g = table(spark, sf, "customer").select(F.col("c_custkey").alias("generation_id"), F.col("c_name").alias("generation"), F.col("c_nationkey").alias("profile_id"))
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("profile_id"), F.col("n_name").alias("profile"), F.col("n_regionkey").alias("object_id"))
    o = table(spark, sf, "region").select(F.col("r_regionkey").alias("object_id"), F.col("r_name").alias("object"))
    return catalog.manifest(v, g, p, o).select("snapshot_id", "generation", "profile", "object")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def broken_views(spark, sf):
    v = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("generation_id"), F.lit(1).alias("source_id"))
    g = table(spark, sf, "customer").select(F.col("c_custkey").alias("generation_id"), F.lit(1).alias("source_id"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("staged").alias("status"))
    return catalog.broken_views(v, g).select("o_orderkey")


@query("SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS transitions, count(*) FILTER (WHERE event_type = 'view') AS token FROM events GROUP BY user_id")
def job_state_fold(spark, sf):
    return catalog.fold_jobs(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("SELECT r_regionkey, 'region_' || sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || CAST(r_regionkey AS VARCHAR) || '}') AS id FROM region")
def content_ids(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", text.content_id("region", "r_name", "r_regionkey").alias("id"))


@query("SELECT n_nationkey, n_name FROM nation")
def idempotent_insert(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    once = catalog.insert_new(n.filter("n_nationkey < 10"), n, "n_nationkey")
    return catalog.insert_new(once, n, "n_nationkey")


@query("SELECT name AS file, count(*) AS n_occurrences, count(*) FILTER (WHERE vid % 2 = 1) AS n_symbols, 'partial' AS completeness FROM files GROUP BY name", FILES_SQL)
def occurrence_batches(spark, sf):
    o = files(spark, sf).select(F.col("name").alias("file"), F.col("file").alias("symbol"), (F.col("vid") % 2).cast("int").alias("roles"))
    return facts.occurrences_to_batches(o).select("file", "n_occurrences", "n_symbols", "completeness")


@query("SELECT 'f.py' AS file, CAST(n_nationkey AS INT) AS start_line, 1 AS start_char, CAST(n_nationkey AS INT) AS end_line, CAST(n_nationkey + 5 AS INT) AS end_char, 'sym' AS symbol, CAST(n_regionkey AS INT) AS roles FROM nation")
def occurrence_parser(spark, sf):
    n = table(spark, sf, "nation").select(F.lit("f.py").alias("file"), F.format_string("%d:1-%d sym %d", F.col("n_nationkey"), F.col("n_nationkey") + 5, F.col("n_regionkey")).alias("line"))
    return repository.parse_occurrences(n)


PLANNED = "how does `license` handling under the apache license work"


@query(
    bm25_sql(re.findall("[a-z0-9]+", PLANNED))
    + f""", a AS (SELECT doc_id AS id, 0.4 AS w, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s), b AS (SELECT e.vec_id AS id, 0.6 AS w, row_number() OVER (ORDER BY {VEC} DESC, e.vec_id) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT id, round(CAST(sum(w / (60 + r)) AS DOUBLE), 9) AS score FROM (SELECT * FROM a WHERE r <= 100 UNION ALL SELECT * FROM b WHERE r <= 100) GROUP BY id ORDER BY sum(w / (60 + r)) DESC, id LIMIT 20"""
)
def planned_search(spark, sf):
    """A question of both kinds of evidence: sparse and dense lists, fused."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    e = table(spark, sf, "embeddings")
    q = PLANNED
    plan = planner.select(q, {"sparse", "dense"})
    return planner.execute(plan, q, 20, d, e, e.filter("vec_id = 0")).withColumn("score", F.round("score", 9))


@query(
    bm25_sql(["who", "calls", "old", "widget"]).replace("SELECT doc_id, list_transform", "SELECT p_partkey + 3000000000 AS doc_id, list_transform").replace("replace(text,", "replace(p_name,").replace("FROM documents", "FROM part").replace("WITH tok", "WITH RECURSIVE tok")
    + """, seed AS (SELECT doc_id AS vid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score FROM s ORDER BY score DESC, doc_id LIMIT 8),
r AS (SELECT CAST(vid AS BIGINT) AS vid, 0 AS depth FROM seed UNION SELECT CAST(t AS BIGINT), depth + 1 FROM r JOIN (SELECT src AS f, dst AS t FROM edges UNION SELECT dst, src FROM edges) ON f = vid WHERE depth < 2),
near AS (SELECT vid, min(depth) AS depth FROM r GROUP BY vid HAVING min(depth) > 0 ORDER BY depth, vid LIMIT 100),
every AS (SELECT vid, 0 AS tier, CAST(rank AS DOUBLE) AS place, score FROM seed UNION ALL SELECT vid, 1, depth, 1.0 / (depth + 1) FROM near)
SELECT CAST(vid AS BIGINT) AS id, round(CAST(score AS DOUBLE), 9) AS score FROM every ORDER BY tier, place, vid LIMIT 20""",
    EDGES_SQL,
)
def graph_seeded_search(spark, sf):
    """A structural question: sparse seeds, and what lies around them."""
    p = table(spark, sf, "part").select((F.col("p_partkey") + 3000000000).alias("id"), F.col("p_name").alias("content"))
    q = "who calls old widget"
    plan = planner.select(q, {"sparse", "graph"})
    return planner.execute(plan, q, 20, p, edges=edges(spark, sf)).withColumn("score", F.round("score", 9))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def per_group_top(spark, sf):
    return filters.per_group(table(spark, sf, "documents"), "source", 3, F.desc("n_chars"), "doc_id").select("source", "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def top_k_rows(spark, sf):
    return ranking.top_k(table(spark, sf, "lineitem"), 25, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")
