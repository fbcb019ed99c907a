"""Queries of the ranked-list, vector and interval operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope.operators import filters, intervals, ranking, vectors
from corpuscope.plans.registry import query
from corpuscope.plans.views import CANDIDATES_SQL, FILES_SQL, POINTS_SQL, SPANS_SQL, candidates, files, points, spans, table
from corpuscope.session import shared_folder
from corpuscope.sources import repository


@query("SELECT branch, rank, node_id, round(CASE WHEN coalesce(score, 0) = 0 THEN 1.0 / rank ELSE score END, 9) AS score FROM candidates", CANDIDATES_SQL)
def normalize_results(spark, sf):
    return ranking.normalize_results(candidates(spark, sf)).select("branch", "rank", "node_id", F.round("score", 9).alias("score"))


@query(
    """WITH w AS (SELECT *, CASE branch WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 1.0 END * CASE WHEN coalesce(score, 0) = 0 THEN 1.0 / rank ELSE score END AS o FROM candidates)
SELECT node_id, round(sum(o), 6) AS score, arg_min(branch, branch * 1000 + rank) AS branch, arg_min(rank, branch * 1000 + rank) AS rank FROM w GROUP BY node_id""",
    CANDIDATES_SQL,
)
def fusion_weighted(spark, sf):
    return ranking.fuse(candidates(spark, sf), "node_id", "weighted", {0: 0.5, 1: 0.3}).select("node_id", F.round("score", 6).alias("score"), "branch", "rank")


@query("SELECT node_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM candidates GROUP BY node_id ORDER BY sum(1.0 / (60 + rank)) DESC, node_id LIMIT 20", CANDIDATES_SQL)
def fusion_rrf(spark, sf):
    return ranking.top_k(ranking.fuse(candidates(spark, sf), "node_id", "rrf"), 20, F.desc("score"), "node_id").select("node_id", F.round("score", 9).alias("score"))


@query(
    """WITH o AS (SELECT branch, file, min(rank) AS rank FROM candidates GROUP BY ALL), r AS (SELECT file, row_number() OVER (PARTITION BY branch ORDER BY rank) AS rank FROM o)
SELECT file, round(sum(1.0 / (60 + rank)), 9) AS score FROM r GROUP BY file""",
    CANDIDATES_SQL,
)
def file_rrf(spark, sf):
    return ranking.fuse_by_file(candidates(spark, sf)).select("file", F.round("score", 9).alias("score"))


@query(
    """SELECT node_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS first_rank, string_agg(CAST(branch AS VARCHAR), ',' ORDER BY branch) AS routes
FROM (SELECT node_id, branch, min(rank) AS rank FROM candidates GROUP BY ALL) GROUP BY node_id""",
    CANDIDATES_SQL,
)
def provenance_rrf(spark, sf):
    p = ranking.provenance_rrf(candidates(spark, sf), "node_id")
    return p.select("node_id", F.round("score", 9).alias("score"), "first_rank", F.array_join(F.col("routes").cast("array<string>"), ",").alias("routes"))


@query(
    """WITH c AS (SELECT *, branch * 1000 + rank AS pos FROM candidates)
SELECT node_id, min(pos) AS pos, coalesce(length(arg_min(content, pos) FILTER (WHERE content <> '')), 0) AS content_length FROM c GROUP BY node_id""",
    CANDIDATES_SQL,
)
def dedup_nodes(spark, sf):
    d = ranking.dedup(candidates(spark, sf).withColumn("pos", F.col("branch") * 1000 + F.col("rank")), "node_id", "pos")
    return d.select("node_id", "pos", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("content_length"))


@query(
    """SELECT node_id, file, rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank) > 2 AS off FROM candidates WHERE branch = 0) ORDER BY off, rank LIMIT 45""",
    CANDIDATES_SQL,
)
def diversify_by_file(spark, sf):
    return ranking.diversify(candidates(spark, sf).filter("branch = 0"), "file", 2, 45).select("node_id", "file", "rank")


@query("SELECT node_id, pos // 10 AS rank, pos % 10 AS branch FROM (SELECT node_id, min(rank * 10 + branch) AS pos FROM candidates GROUP BY node_id)", CANDIDATES_SQL)
def interleave(spark, sf):
    return ranking.interleave(candidates(spark, sf), "node_id")


@query(
    """WITH f AS (SELECT node_id, sum(1.0 / (60 + rank)) AS score, count(DISTINCT branch) AS nb, min(branch) AS lone FROM candidates GROUP BY node_id),
p AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, node_id) AS place FROM f),
t AS (SELECT *, CASE WHEN place <= 10 THEN 0 WHEN nb = 1 AND row_number() OVER (PARTITION BY CASE WHEN nb = 1 AND place > 10 THEN lone END ORDER BY place) = 1 THEN 1 ELSE 2 END AS tier FROM p)
SELECT node_id, CAST(tier AS BIGINT) AS tier FROM t ORDER BY t.tier, place LIMIT 20""",
    CANDIDATES_SQL,
)
def branch_coverage(spark, sf):
    c = candidates(spark, sf)
    fused = ranking.fuse(c, "node_id", "rrf").withColumn("score", F.round("score", 12))
    return ranking.branch_coverage(fused, c, "node_id", 20).select("node_id", F.col("tier").cast("long").alias("tier"))


@query(
    """WITH o AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM o)
SELECT file, min(s) AS s, max(e) AS e FROM n GROUP BY file, i""",
    SPANS_SQL,
)
def interval_union(spark, sf):
    return ranking.interval_union(spans(spark, sf), "file", "s", "e")


@query(
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY branch) AS n, row_number() OVER (PARTITION BY branch ORDER BY rank) AS place FROM candidates), a AS (SELECT *, least(n, 4000 // 100) AS adm FROM c)
SELECT branch, place, 4000 // adm + CASE WHEN place = adm THEN 4000 % adm ELSE 0 END AS allowance, length(substr(content, 1, CAST(4000 // adm + CASE WHEN place = adm THEN 4000 % adm ELSE 0 END AS BIGINT))) AS projected FROM a WHERE place <= adm""",
    CANDIDATES_SQL,
)
def content_budget(spark, sf):
    b = ranking.content_budget(candidates(spark, sf), "branch", 4000, 100)
    return b.select("branch", F.col("place").cast("long").alias("place"), F.col("allowance").cast("long").alias("allowance"), F.length("projected").cast("long").alias("projected"))


@query(
    """WITH s AS (SELECT branch, rank, node_id % 97 AS sc FROM candidates), w AS (SELECT branch, rank, sc, unnest(range(1, 61, 5)) AS b FROM s)
SELECT branch, rank, round(avg(sc), 9) AS score, count(*) AS windows FROM w WHERE b <= rank AND rank < b + 10 GROUP BY branch, rank""",
    CANDIDATES_SQL,
)
def window_rerank(spark, sf):
    return ranking.window_rerank(candidates(spark, sf), 10, 5, (F.col("node_id") % 97).cast("double")).withColumn("score", F.round("score", 9))


@query(
    """WITH x AS (SELECT node_id, list_filter([rank - 1, 2, 98, 0], lambda x: x BETWEEN 0 AND 4) AS l FROM candidates), y AS (SELECT node_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM x)
SELECT DISTINCT node_id, array_to_string(l || list_filter([0, 1, 2, 3, 4], lambda x: NOT list_contains(l, x)), ',') AS "order" FROM y""",
    CANDIDATES_SQL,
)
def permutation_parser(spark, sf):
    c = candidates(spark, sf).select("node_id", ranking.parse_permutation(F.concat_ws(" > ", F.col("rank").cast("string"), F.lit("3"), F.lit("99"), F.lit("1")), F.lit(5)).alias("order"))
    return c.select("node_id", F.array_join(F.col("order").cast("array<string>"), ",").alias("order")).distinct()


@query("SELECT branch, rank, node_id FROM candidates WHERE score >= 5.0", CANDIDATES_SQL)
def score_threshold(spark, sf):
    return filters.score_threshold(candidates(spark, sf), 5.0).select("branch", "rank", "node_id")


@query(
    """SELECT vid, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY vid) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM files)
WHERE i IN (0, round_even(0.25 * (n - 1), 0), round_even(0.5 * (n - 1), 0), round_even(0.75 * (n - 1), 0), n - 1)""",
    FILES_SQL,
)
def percentile_picks(spark, sf):
    return filters.percentile_picks(files(spark, sf), "name", ["vid"]).select("vid", "name")


@query("SELECT vid, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY vid) AS t FROM files) ORDER BY t, name, vid LIMIT 77", FILES_SQL)
def round_robin_quota(spark, sf):
    return filters.round_robin_quota(files(spark, sf), "name", ["vid"], 77).select("vid", "name")


VEC = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))"


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e, e.filter("vec_id = 0")


@query(f"SELECT e.vec_id, round({VEC}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {VEC} DESC, e.vec_id LIMIT 10")
def vector_topk_ip(spark, sf):
    e, q = _emb(spark, sf)
    return vectors.search(e, q, 10).select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT e.vec_id, round({L2}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {L2}, e.vec_id LIMIT 10")
def vector_topk_l2(spark, sf):
    e, q = _emb(spark, sf)
    return vectors.search(e, q, 10, metric="l2").select("vec_id", F.round("score", 5).alias("score"))


@query(
    f"WITH t AS (SELECT e.vec_id, e.label, {VEC} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), k AS (SELECT * FROM t WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 20) SELECT vec_id, round(s, 5) AS score FROM k WHERE label < 5"
)
def vector_threshold_mask(spark, sf):
    e, q = _emb(spark, sf)
    return vectors.search(e, q, 20, threshold=0.1, mask=e.filter("label < 5").select("vec_id")).select("vec_id", F.round("score", 5).alias("score"))


@query(
    f"WITH t AS (SELECT e.vec_id, e.vec_id // 4 AS node_id, {VEC} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id // 4 % 3 = 0), b AS (SELECT node_id, max(s) AS s, arg_max(vec_id, s) AS vec_id FROM t GROUP BY node_id) SELECT node_id, vec_id, round(s, 5) AS score FROM b ORDER BY s DESC, vec_id LIMIT 15"
)
def vector_masked_best_per_node(spark, sf):
    e, q = _emb(spark, sf)
    e = e.withColumn("node_id", F.expr("vec_id div 4"))
    return vectors.search_within(e, q, e.filter("node_id % 3 = 0").select("node_id").distinct(), 15).select("node_id", "vec_id", F.round("score", 5).alias("score"))


@query(
    f"""WITH t AS (SELECT e.vec_id, e.label, e.vec_id % 2 AS lvl, {VEC} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
c AS (SELECT * FROM t WHERE lvl = 0 ORDER BY s DESC, vec_id LIMIT 5), f AS (SELECT * FROM t WHERE lvl = 1 ORDER BY s DESC, vec_id LIMIT 15)
SELECT vec_id, round(s, 5) AS score FROM f WHERE label IN (SELECT label FROM c) ORDER BY s DESC, vec_id LIMIT 5"""
)
def hierarchical_search(spark, sf):
    e, q = _emb(spark, sf)
    return vectors.hierarchical(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), q, 5, file="label").select("vec_id", F.round("score", 5).alias("score"))


@query(
    f"""WITH c AS (SELECT branch, rank, node_id, content FROM candidates WHERE branch = 0), t AS (SELECT e.vec_id, {L2} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT node_id, round(-sqrt(s), 5) AS score FROM c JOIN t ON node_id = vec_id WHERE content <> ''""",
    CANDIDATES_SQL,
)
def content_rerank(spark, sf):
    e, q = _emb(spark, sf)
    c = candidates(spark, sf).filter("branch = 0").withColumn("vec_id", F.col("node_id"))
    return vectors.content_rerank(c, e, q, "vec_id", "l2").select("node_id", F.round("score", 5).alias("score"))


@query(
    f"""WITH c AS (SELECT rank, node_id FROM candidates WHERE branch = 0), t AS (SELECT e.vec_id, {VEC} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT node_id, row_number() OVER (ORDER BY s IS NULL, s DESC, rank) AS position FROM c LEFT JOIN t ON node_id = vec_id""",
    CANDIDATES_SQL,
)
def indexed_rerank(spark, sf):
    e, q = _emb(spark, sf)
    r = vectors.indexed_rerank(candidates(spark, sf).filter("branch = 0").withColumn("vec_id", F.col("node_id")), e, q, "vec_id")
    return ranking.ranked(r, F.desc("matched"), F.desc("vector_score"), "rank").select("node_id", F.col("position").cast("long").alias("position"))


@query("SELECT label, count(*) AS vectors, 64::BIGINT AS dim FROM embeddings GROUP BY label")
def vector_stats(spark, sf):
    return vectors.stats(table(spark, sf, "embeddings"), "label")


@query("SELECT vec_id % 90 AS content_hash, min(vec_id) AS vec_id FROM embeddings GROUP BY 1")
def embeddings_by_hash(spark, sf):
    return vectors.by_hash(table(spark, sf, "embeddings").withColumn("content_hash", F.col("vec_id") % 90), "content_hash").select("content_hash", "vec_id")


@query(
    """WITH o AS (SELECT vec_id, vec_id % 37 AS h, row_number() OVER (PARTITION BY vec_id % 37 ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 5 <> 0), w AS (SELECT vec_id, vec_id % 37 AS h, row_number() OVER (PARTITION BY vec_id % 37 ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 3 <> 0)
SELECT h, count(*) FILTER (WHERE o.vec_id IS NOT NULL AND w.vec_id IS NOT NULL) AS kept, count(*) FILTER (WHERE w.vec_id IS NULL) AS removed, count(*) FILTER (WHERE o.vec_id IS NULL) AS added FROM o FULL JOIN w USING (h, n) GROUP BY h"""
)
def vector_delta(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("h", F.col("vec_id") % 37)
    d, _ = vectors.delta(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 3 <> 0"), "h", "vec_id")
    return d.groupBy("h").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("kept", "removed", "added")])


@query()
def ivf_search(spark, sf):
    e, q = _emb(spark, sf)
    return vectors.ivf_search(e, vectors.ivf_centroids(e), q, 10).select("vec_id", F.round("score", 5).alias("score"))


@query()
def ivf_stored(spark, sf):
    e, q = _emb(spark, sf)
    path = f"{shared_folder(spark)}/views/ivf-{uuid.uuid4().hex}"
    vectors.write_ivf(e.select("vec_id", "embedding"), vectors.ivf_centroids(e), path)
    return vectors.ivf_stored(spark, path, q, 10).select("vec_id", F.round("score", 5).alias("score"))


@query("SELECT count(*) AS pairs, CAST(sum(a.id) AS BIGINT) AS left_sum, CAST(sum(b.id) AS BIGINT) AS right_sum FROM spans a JOIN spans b ON a.file = b.file AND a.s <= b.e AND b.s <= a.e", SPANS_SQL)
def interval_overlap(spark, sf):
    a = spans(spark, sf).select("file", F.col("s").alias("ls"), F.col("e").alias("le"), F.col("id").alias("left_id"))
    b = spans(spark, sf).select("file", F.col("s").alias("rs"), F.col("e").alias("re"), F.col("id").alias("right_id"))
    return intervals.overlap_join(a, b, "file", "ls", "le", "rs", "re").agg(F.count("*").alias("pairs"), F.sum("left_id").alias("left_sum"), F.sum("right_id").alias("right_sum"))


@query(
    "SELECT event_id, p.file, line, arg_min(id, (CASE WHEN s <> line THEN 1 ELSE 0 END) * 1000000000000 + (e - s) * 10000000000 + id) AS scope FROM points p LEFT JOIN spans x ON p.file = x.file AND line BETWEEN s AND e GROUP BY ALL",
    SPANS_SQL, POINTS_SQL,
)
def innermost_scope(spark, sf):
    return intervals.innermost(points(spark, sf), spans(spark, sf), "file", "line", "s", "e", "event_id", "id").select("event_id", "file", "line", "scope")


@query("SELECT event_id, arg_min(id, (e - s) * 10000000000000 - s * 10000000000 + id) AS entity FROM points p JOIN spans x ON p.file = x.file AND line BETWEEN s AND e GROUP BY ALL", SPANS_SQL, POINTS_SQL)
def narrowest_entity(spark, sf):
    return intervals.narrowest(points(spark, sf), spans(spark, sf), "file", "line", "s", "e", "event_id", "id")


OCC_SQL = """occ AS (SELECT DISTINCT l_suppkey AS file, CAST(l_partkey % 60 AS INT) AS start_line, CAST(l_partkey % 40 AS INT) AS start_char, CAST(l_partkey % 60 AS INT) AS end_line, CAST(l_partkey % 40 + 5 AS INT) AS end_char,
  (CASE WHEN l_partkey % 4 = 0 THEN 'local ' ELSE 'sym ' END) || CAST(l_partkey % 300 AS VARCHAR) AS symbol, CAST(l_linenumber % 2 AS INT) AS roles FROM lineitem),
places AS (SELECT event_id, user_id % 100 AS file, CAST(event_id % 60 AS INT) AS line, CAST(event_id % 45 AS INT) AS "char" FROM events)"""


def _occ(spark, sf):
    p = F.col("l_partkey")
    occ = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("file"), (p % 60).cast("int").alias("start_line"), (p % 40).cast("int").alias("start_char"), (p % 60).cast("int").alias("end_line"), (p % 40 + 5).cast("int").alias("end_char"),
        F.concat(F.when(p % 4 == 0, "local ").otherwise("sym "), (p % 300).cast("string")).alias("symbol"), (F.col("l_linenumber") % 2).cast("int").alias("roles"),
    ).distinct()
    i = F.col("event_id")
    return occ, table(spark, sf, "events").select("event_id", (F.col("user_id") % 100).alias("file"), (i % 60).cast("int").alias("line"), (i % 45).cast("int").alias("char"))


@query('SELECT event_id, arg_min(symbol, lpad(CAST(start_line * 1048576 + start_char AS VARCHAR), 12, \'0\') || lpad(CAST(end_line * 1048576 + end_char AS VARCHAR), 12, \'0\') || symbol) AS symbol FROM places JOIN occ ON places.file = occ.file AND line = start_line AND "char" >= start_char AND "char" < end_char GROUP BY event_id', OCC_SQL)
def occurrence_at(spark, sf):
    occ, at = _occ(spark, sf)
    return intervals.occurrence_at(at, occ, "event_id")


@query(
    """WITH f AS (SELECT event_id, arg_min(symbol, lpad(CAST(start_line * 1048576 + start_char AS VARCHAR), 12, '0') || lpad(CAST(end_line * 1048576 + end_char AS VARCHAR), 12, '0') || symbol) AS symbol FROM places JOIN occ ON places.file = occ.file AND line = start_line AND "char" >= start_char AND "char" < end_char GROUP BY event_id),
d AS (SELECT DISTINCT event_id, f.symbol, file, start_line, start_char FROM f JOIN occ ON f.symbol = occ.symbol AND roles % 2 = 1)
SELECT event_id, file, CAST(start_line AS BIGINT) AS start_line FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY file, start_line, start_char) AS n FROM d) WHERE n <= 5""",
    OCC_SQL,
)
def definitions_at(spark, sf):
    occ, at = _occ(spark, sf)
    found = intervals.occurrence_at(at, occ, "event_id")
    return intervals.locations(found, occ, "event_id", True, 5).select("event_id", "file", F.col("start_line").cast("long").alias("start_line"))


PRED_SQL = """pred AS (SELECT file AS q, row_number() OVER (PARTITION BY file ORDER BY id) AS rank, s % 9 AS file, s, e FROM spans), preds AS (SELECT * FROM pred WHERE rank <= 12),
truth AS (SELECT DISTINCT file AS q, s % 9 AS file, s, s + 5 AS e, id AS block FROM spans WHERE id % 17 = 0)"""


def _pred(spark, sf):
    from pyspark.sql import Window as W

    x = spans(spark, sf)
    p = x.select(F.col("file").alias("q"), F.row_number().over(W.partitionBy("file").orderBy("id")).alias("rank"), (F.col("s") % 9).alias("file"), "s", "e").filter("rank <= 12")
    t = x.filter("id % 17 = 0").select(F.col("file").alias("q"), (F.col("s") % 9).alias("file"), "s", (F.col("s") + 5).alias("e"), F.col("id").alias("block")).distinct()
    return p, t


@query(
    """WITH ks AS (SELECT unnest([1, 5, 10]) AS k), h AS (SELECT p.q, p.rank, t.block FROM preds p JOIN truth t ON p.q = t.q AND p.file = t.file AND p.s <= t.e AND t.s <= p.e),
b AS (SELECT q, k, count(DISTINCT block) AS n FROM truth, ks GROUP BY ALL), c AS (SELECT q, k, count(DISTINCT block) AS bl, count(DISTINCT rank) AS ot FROM h, ks WHERE rank <= k GROUP BY ALL), g AS (SELECT q, k, count(*) AS n FROM preds, ks WHERE rank <= k GROUP BY ALL)
SELECT b.q, CAST(b.k AS INT) AS k, round(coalesce(bl, 0) / b.n, 6) AS recall, round(coalesce(ot, 0) / greatest(coalesce(g.n, 0), 1), 6) AS "precision" FROM b LEFT JOIN c USING (q, k) LEFT JOIN g USING (q, k)""",
    SPANS_SQL, PRED_SQL,
)
def span_overlap_metrics(spark, sf):
    p, t = _pred(spark, sf)
    m = intervals.block_metrics(p, t, "q", [1, 5, 10])
    return m.select("q", "k", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(
    """WITH core AS (SELECT q, file, s AS cs, e AS ce, CASE WHEN block % 2 = 0 THEN 1.5 ELSE 1.0 END AS w FROM truth),
g AS (SELECT p.q, rank, p.e - p.s + 1 AS lines, coalesce(sum(greatest(least(e, ce) - greatest(s, cs) + 1, 0) * w), 0.0) AS gain FROM preds p LEFT JOIN core c ON p.q = c.q AND p.file = c.file GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS i, sum(lines) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM g),
d AS (SELECT q, sum(gain / log2(i + 1)) AS dcg FROM a WHERE used <= 100 OR i = 1 GROUP BY q),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY gain / lines DESC, rank) AS i, sum(lines) OVER (PARTITION BY q ORDER BY gain / lines DESC, rank ROWS UNBOUNDED PRECEDING) AS used FROM g),
x AS (SELECT q, sum(gain / log2(i + 1)) AS ideal FROM b WHERE used <= 100 OR i = 1 GROUP BY q)
SELECT d.q, round(dcg, 6) AS dcg, round(CASE WHEN ideal > 0 THEN least(dcg / ideal, 1.0) ELSE 0.0 END, 6) AS ndcg FROM d JOIN x USING (q)""",
    SPANS_SQL, PRED_SQL,
)
def ndcg_line_budget(spark, sf):
    p, t = _pred(spark, sf)
    m = intervals.line_budget_ndcg(p, t.withColumn("weight", F.when(F.col("block") % 2 == 0, 1.5).otherwise(1.0)), "q", 100)
    return m.select("q", F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


@query(
    """WITH a AS (SELECT *, coalesce(sum(e - s + 1) OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM preds),
l AS (SELECT DISTINCT q, file, unnest(range(s, CAST(least(e, s + 100 - before - 1) + 1 AS BIGINT))) AS line FROM a WHERE before < 100), w AS (SELECT DISTINCT q, file, unnest(range(s, e + 1)) AS line FROM truth)
SELECT w.q, round(count(l.line) / count(*), 6) AS recall FROM w LEFT JOIN l ON w.q = l.q AND w.file = l.file AND w.line = l.line GROUP BY w.q""",
    SPANS_SQL, PRED_SQL,
)
def line_recall_budget(spark, sf):
    p, t = _pred(spark, sf)
    return intervals.line_budget_recall(p, t, "q", 100).withColumn("recall", F.round("recall", 6))


def _budget_sql(n):
    return f"""d{n} AS (SELECT q, sum(CASE WHEN used <= {n} OR i = 1 THEN gain / log2(i + 1) ELSE 0 END) AS dcg FROM placed GROUP BY q), x{n} AS (SELECT q, sum(CASE WHEN used <= {n} OR i = 1 THEN gain / log2(i + 1) ELSE 0 END) AS ideal FROM best GROUP BY q),
k{n} AS (SELECT q, count(*) AS hit FROM (SELECT DISTINCT q, file, line FROM (SELECT q, file, unnest(range(s, least(e, s + {n} - before - 1) + 1)) AS line FROM spent WHERE before < {n}) JOIN cl USING (q, file, line)) GROUP BY q)"""


CONTEXT_SQL = f"""WITH reg AS (SELECT q, rank, file, CASE WHEN rank % 5 = 0 THEN -40 ELSE s + 1 END AS a, CASE WHEN rank % 7 = 0 THEN -1 ELSE e + 1 END AS b FROM preds),
cor AS (SELECT q, file, s + 1 AS a, e + 1 AS b, block FROM truth), opt AS (SELECT DISTINCT file AS q, s % 9 AS file, s + 1 AS a, s + 4 AS b FROM spans WHERE id % 19 = 0),
role AS (SELECT DISTINCT q, file, 'core' AS role FROM cor UNION SELECT q, file, 'optional' FROM opt UNION SELECT q, file, 'main' FROM cor WHERE file % 3 = 0),
p AS (SELECT q, rank, file, CASE WHEN a < 0 OR b = -1 THEN greatest(1, least(CASE WHEN a < 0 THEN 700 + a + 1 ELSE a END, 700)) ELSE greatest(1, a) END AS s, CASE WHEN a < 0 OR b = -1 THEN greatest(1, least(CASE WHEN b = -1 THEN 700 ELSE b END, 700)) ELSE b END AS e FROM reg),
pl AS (SELECT DISTINCT q, file, unnest(range(s, e + 1)) AS line FROM p), cl AS (SELECT DISTINCT q, file, unnest(range(a, b + 1)) AS line FROM cor), ol AS (SELECT DISTINCT q, file, unnest(range(a, b + 1)) AS line FROM opt), col AS (SELECT * FROM cl UNION SELECT * FROM ol),
n AS (SELECT q, (SELECT count(*) FROM pl WHERE pl.q = x.q) AS n_p, (SELECT count(*) FROM cl WHERE cl.q = x.q) AS n_c, (SELECT count(*) FROM ol WHERE ol.q = x.q) AS n_o FROM (SELECT DISTINCT q FROM reg) x),
m1 AS (SELECT q, count(*) AS n FROM pl JOIN cl USING (q, file, line) GROUP BY q), m2 AS (SELECT q, count(*) AS n FROM pl JOIN ol USING (q, file, line) GROUP BY q), m3 AS (SELECT q, count(*) AS n FROM pl JOIN col USING (q, file, line) GROUP BY q),
pf AS (SELECT DISTINCT q, file FROM reg), cf AS (SELECT q, file FROM role WHERE role = 'core'), f1 AS (SELECT q, count(*) AS n FROM pf JOIN cf USING (q, file) GROUP BY q), f2 AS (SELECT q, count(*) AS n FROM cf GROUP BY q),
f3 AS (SELECT q, count(*) FILTER (WHERE (q, file) NOT IN (SELECT (q, file) FROM role WHERE role <> 'main')) AS n, count(*) AS total FROM pf GROUP BY q),
ch AS (SELECT q, file, a, b, block, (SELECT count(*) FROM pl WHERE pl.q = cor.q AND pl.file = cor.file AND line BETWEEN a AND b) AS n, CASE WHEN file % 3 = 0 THEN 3.0 ELSE 2.0 END AS w FROM cor),
c1 AS (SELECT q, count(*) FILTER (WHERE n > 0) / count(*) AS hit, sum(w * n / (b - a + 1)) / sum(w) AS cover FROM ch GROUP BY q),
g AS (SELECT q, rank, greatest(e - s + 1, 0) AS lines, (SELECT count(*) FROM cl WHERE cl.q = p.q AND cl.file = p.file AND line BETWEEN s AND e) AS n, (SELECT count(*) FROM col WHERE col.q = p.q AND col.file = p.file AND line BETWEEN s AND e) AS known,
  CASE WHEN (q, file) IN (SELECT (q, file) FROM role WHERE role = 'main') THEN 1.5 ELSE 1.0 END AS w FROM p),
r1 AS (SELECT q, count(*) FILTER (WHERE known = 0) / count(*) AS noise, coalesce(1 - (min(rank) FILTER (WHERE n > 0) - 1) / count(*), 0) AS first FROM g GROUP BY q),
placed AS (SELECT q, n * w AS gain, row_number() OVER (PARTITION BY q ORDER BY rank) AS i, sum(lines) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM g),
best AS (SELECT q, n * w AS gain, row_number() OVER (PARTITION BY q ORDER BY n * w / greatest(lines, 1) DESC, rank) AS i, sum(lines) OVER (PARTITION BY q ORDER BY n * w / greatest(lines, 1) DESC, rank ROWS UNBOUNDED PRECEDING) AS used FROM g),
spent AS (SELECT q, file, s, e, CAST(coalesce(sum(greatest(e - s + 1, 0)) OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM p),
{_budget_sql(100)}, {_budget_sql(300)}, {_budget_sql(500)},
t AS (SELECT n.q, CASE WHEN n_p > 0 THEN coalesce(m1.n, 0) / n_p ELSE 0 END AS p, CASE WHEN n_c > 0 THEN coalesce(m1.n, 0) / n_c ELSE 0 END AS r, coalesce(f1.n / f2.n, 0) AS hit_file_rate, coalesce(f3.n / f3.total, 0) AS noise_file_rate,
  coalesce(c1.hit, 0) AS hit_region_rate, coalesce(r1.noise, 0) AS noise_region_rate, coalesce(c1.cover, 0) AS weighted_core_coverage, CASE WHEN n_p > 0 THEN coalesce(m3.n, 0) / n_p ELSE 0 END AS context_efficiency, CASE WHEN n_o > 0 THEN coalesce(m2.n, 0) / n_o ELSE 0 END AS optional_coverage,
  {", ".join(f"CASE WHEN n_c > 0 AND ideal{k} > 0 THEN least(dcg{k} / ideal{k}, 1) ELSE 0 END AS ndcg_at_{k}, CASE WHEN n_c > 0 THEN coalesce(hit{k}, 0) / n_c ELSE 0 END AS recall_at_{k}" for k in (100, 300, 500))}, coalesce(r1.first, 0) AS first_useful_hit
  FROM n LEFT JOIN m1 USING (q) LEFT JOIN m2 USING (q) LEFT JOIN m3 USING (q) LEFT JOIN f1 USING (q) LEFT JOIN f2 USING (q) LEFT JOIN f3 USING (q) LEFT JOIN c1 USING (q) LEFT JOIN r1 USING (q)
  {" ".join(f"LEFT JOIN (SELECT q, dcg AS dcg{k} FROM d{k}) USING (q) LEFT JOIN (SELECT q, ideal AS ideal{k} FROM x{k}) USING (q) LEFT JOIN (SELECT q, hit AS hit{k} FROM k{k}) USING (q)" for k in (100, 300, 500))})
SELECT q, round(CAST(p AS DOUBLE), 6) AS "precision", round(CAST(r AS DOUBLE), 6) AS recall, round(CAST(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS DOUBLE), 6) AS f1_score,
{", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in intervals.CONTEXT_METRICS[3:])} FROM t"""


@query(CONTEXT_SQL, SPANS_SQL, PRED_SQL)
def region_metrics(spark, sf):
    """All seventeen metrics of retrieved context."""
    p, t = _pred(spark, sf)
    n = F.col("rank")
    regions = p.select("q", n.cast("long").alias("rank"), "file", F.when(n % 5 == 0, -40).otherwise(F.col("s") + 1).alias("start"), F.when(n % 7 == 0, -1).otherwise(F.col("e") + 1).alias("end"))
    one = lambda df, s, e: df.select("q", "file", (F.col("s") + s).alias("start"), (F.col(e[0]) + e[1]).alias("end"))
    core = one(t, 1, ("e", 1))
    optional = one(spans(spark, sf).filter("id % 19 = 0").select(F.col("file").alias("q"), (F.col("s") % 9).alias("file"), "s").distinct(), 1, ("s", 4))
    role = lambda df, r: df.select("q", "file", F.lit(r).alias("role")).distinct()
    roles = role(core, "core").unionByName(role(optional, "optional")).unionByName(role(core.filter("file % 3 = 0"), "main"))
    lengths = spark.range(9).select(F.col("id").alias("file"), F.lit(700).alias("n_lines"))
    m = intervals.context_metrics(regions, core, optional, roles, lengths, "q")
    return m.select("q", *[F.round(c, 6).alias(c) for c in intervals.CONTEXT_METRICS])


@query(
    """WITH RECURSIVE r AS (SELECT q, CAST(0 AS BIGINT) AS rank, CAST([] AS STRUCT(rank BIGINT, file BIGINT, s BIGINT, e BIGINT)[]) AS kept FROM (SELECT DISTINCT q FROM preds)
UNION ALL SELECT r.q, p.rank, CASE WHEN len(list_filter(kept, lambda y: y.file = p.file AND y.s <= p.e AND p.s <= y.e)) > 0 THEN kept ELSE list_append(kept, {'rank': p.rank, 'file': p.file, 's': p.s, 'e': p.e}) END FROM r JOIN preds p ON p.q = r.q AND p.rank = r.rank + 1),
x AS (SELECT q, unnest(arg_max(kept, rank)) AS k FROM r GROUP BY q) SELECT q, k.rank AS rank, k.file AS file, k.s AS s, k.e AS e FROM x""",
    SPANS_SQL, PRED_SQL,
)
def greedy_span_dedup(spark, sf):
    p, _ = _pred(spark, sf)
    return intervals.greedy_dedup(p, "q", "rank", "file", "s", "e")


@query(
    """WITH n AS (SELECT o_orderkey AS id, o_custkey % 50 AS s, o_custkey % 50 + o_orderkey % 200 AS e FROM orders), c AS (SELECT *, CAST(ceil((e - s + 1) / 30) AS BIGINT) AS n FROM n), p AS (SELECT *, unnest(range(0, n)) AS piece FROM c)
SELECT id, piece, s + piece * ((e - s + 1) // n) + least(piece, (e - s + 1) % n) AS piece_start, s + piece * ((e - s + 1) // n) + least(piece, (e - s + 1) % n) + (e - s + 1) // n + CASE WHEN piece < (e - s + 1) % n THEN 1 ELSE 0 END - 1 AS piece_end FROM p"""
)
def balanced_split(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("s"), (F.col("o_custkey") % 50 + F.col("o_orderkey") % 200).alias("e"))
    return intervals.split_by_lines(o, "s", "e", 30).select("id", F.col("piece").cast("long").alias("piece"), "piece_start", "piece_end")


@query(
    "SELECT vid, len(string_split(content, chr(10))) AS n_lines, least(vid % 3 + 2, len(string_split(content, chr(10))) - 1) AS e, md5(array_to_string(list_slice(string_split(content, chr(10)), CAST(vid % 3 + 1 AS BIGINT), CAST(vid % 3 + 3 AS BIGINT)), chr(10))) AS h FROM files WHERE len(string_split(content, chr(10))) > vid % 3",
    FILES_SQL,
)
def hydrate_content(spark, sf):
    f = files(spark, sf).select("vid", "file", "content")
    n = F.size(F.split("content", "\n", -1))
    c = f.filter(n > F.col("vid") % 3).select("vid", "file", n.cast("long").alias("n_lines"), (F.col("vid") % 3).cast("int").alias("start_line"), (F.col("vid") % 3 + 2).cast("int").alias("end_line"), F.lit(None).cast("string").alias("content"))
    h = repository.hydrate(c, f)
    return h.select("vid", "n_lines", F.least(F.col("end_line").cast("long"), F.col("n_lines") - 1).alias("e"), F.md5("content").alias("h"))


@query("SELECT o_orderkey AS id, 'f' || o_orderkey || '.py' AS file, o_custkey AS s, o_custkey + 2 AS e FROM orders")
def diff_ranges(spark, sf):
    o = table(spark, sf, "orders")
    body = F.format_string("--- a/f%d.py\n+++ b/f%d.py\n@@ -1,2 +%d,3 @@\n+x\n@@ -9 +12,0 @@\n-y", F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_custkey"))
    return intervals.diff_ranges(o.select(F.col("o_orderkey").alias("id"), body.alias("text")))
