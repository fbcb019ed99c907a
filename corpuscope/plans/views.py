"""The tables seen as the engine's own views: files, candidates, a property graph, spans, cells. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import distinct


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FILES_SQL = """files AS (SELECT doc_id AS vid,
  source || CASE WHEN doc_id % 7 = 0 THEN '/tests/' WHEN doc_id % 11 = 0 THEN '/build/' WHEN doc_id % 13 = 0 THEN '/.hidden/' ELSE '/src/' END
  || CASE WHEN doc_id % 5 = 0 THEN 'test_' WHEN doc_id % 5 = 1 THEN 'Thing' ELSE 'mod' END || CAST(doc_id AS VARCHAR)
  || CASE WHEN doc_id % 5 = 1 AND doc_id % 2 = 0 THEN 'Test' ELSE '' END
  || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.d.ts' WHEN 'de' THEN '.min.js' ELSE '.md' END AS file,
  lang AS type, source AS name, text AS content FROM documents)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """vid, file, type, name, content."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    folder = F.when(i % 7 == 0, "/tests/").when(i % 11 == 0, "/build/").when(i % 13 == 0, "/.hidden/").otherwise("/src/")
    stem = F.when(i % 5 == 0, "test_").when(i % 5 == 1, "Thing").otherwise("mod")
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".d.ts").when(F.col("lang") == "de", ".min.js").otherwise(".md")
    file = F.concat("source", folder, stem, i.cast("string"), F.when((i % 5 == 1) & (i % 2 == 0), "Test").otherwise(""), suffix)
    return d.select(i.alias("vid"), file.alias("file"), F.col("lang").alias("type"), F.col("source").alias("name"), F.col("text").alias("content"))


CANDIDATES_SQL = """candidates AS (
  SELECT CAST(b AS BIGINT) AS branch, r AS rank, doc_id AS node_id, source AS file,
    CASE WHEN doc_id % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE n_chars / 1000.0 END AS score, CASE WHEN b = 1 THEN '' ELSE text END AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o, doc_id) AS r FROM (
    SELECT *, 0 AS b, -n_chars AS o FROM documents UNION ALL SELECT *, 1, (doc_id * 7919) % 1009 FROM documents UNION ALL SELECT *, 2, doc_id % 50 FROM documents)) WHERE r <= 60)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Three ranked branches of 60: branch, rank, node_id, file, score, content."""
    from corpuscope.operators.ranking import ranked

    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", F.col("text").alias("head"))
    orders = [-F.col("n_chars"), (F.col("doc_id") * 7919) % 1009, F.col("doc_id") % 50]
    out = None
    for b, o in enumerate(orders):
        top = ranked(d.withColumn("o", o).orderBy("o", "doc_id").limit(60), "o", "doc_id", into="rank").withColumn("branch", F.lit(b).cast("long"))
        out = top if out is None else out.unionByName(top)
    score = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("n_chars") / 1000.0)
    return out.select("branch", F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("node_id"), F.col("source").alias("file"), score.cast("double").alias("score"), F.when(F.col("branch") == 1, "").otherwise(F.col("head")).alias("content"))


EDGES_SQL = """edges AS (
  SELECT CAST(n_nationkey AS BIGINT) AS eid, CAST(100 + n_nationkey AS BIGINT) AS src, CAST(1 + n_regionkey AS BIGINT) AS dst, 'contain' AS type, CAST(NULL AS BIGINT) AS anchor_file, CAST(NULL AS BIGINT) AS anchor_line FROM nation
  UNION ALL SELECT 1000000000 + c_custkey, 1000000000 + c_custkey, 100 + c_nationkey, 'contain', NULL, NULL FROM customer
  UNION ALL SELECT 2000000000 + s_suppkey, 2000000000 + s_suppkey, 100 + s_nationkey, 'contain', NULL, NULL FROM supplier
  UNION ALL SELECT 3000000000 + o_orderkey, 4000000000 + o_orderkey, 1000000000 + o_custkey, 'reference', NULL, NULL FROM orders
  UNION ALL SELECT 1000000000000000 + (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey, 4000000000 + l_orderkey, 3000000000 + l_partkey, 'reference', l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)
  UNION ALL SELECT 2000000000000000 + l_orderkey * 10000000 + l_suppkey, 4000000000 + l_orderkey, 2000000000 + l_suppkey, 'type-use', l_orderkey, NULL FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 3000000000000000 + l_partkey * 10000000 + l_suppkey, 3000000000 + l_partkey, 2000000000 + l_suppkey, 'import', NULL, NULL FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The star schema as a property graph: eid, src, dst, type, anchor_file, anchor_line."""
    line = table(spark, sf, "lineitem")
    null = F.lit(None)

    def rows(df, eid, src, dst, kind, file=null, at=null):
        return df.select(*[x.cast("long").alias(n) for x, n in ((eid, "eid"), (src, "src"), (dst, "dst"))], F.lit(kind).alias("type"), file.cast("long").alias("anchor_file"), at.cast("long").alias("anchor_line"))

    c = F.col
    n, cu, su, o = (table(spark, sf, t) for t in ("nation", "customer", "supplier", "orders"))
    parts = [
        rows(n, c("n_nationkey"), 100 + c("n_nationkey"), 1 + c("n_regionkey"), "contain"),
        rows(cu, 1000000000 + c("c_custkey"), 1000000000 + c("c_custkey"), 100 + c("c_nationkey"), "contain"),
        rows(su, 2000000000 + c("s_suppkey"), 2000000000 + c("s_suppkey"), 100 + c("s_nationkey"), "contain"),
        rows(o, 3000000000 + c("o_orderkey"), 4000000000 + c("o_orderkey"), 1000000000 + c("o_custkey"), "reference"),
        rows(distinct(line.select("l_orderkey", "l_linenumber", "l_partkey")), F.lit(1000000000000000) + (c("l_orderkey") * 10 + c("l_linenumber")) * 10000000 + c("l_partkey"), 4000000000 + c("l_orderkey"), 3000000000 + c("l_partkey"), "reference", c("l_orderkey"), c("l_linenumber")),
        rows(distinct(line.select("l_orderkey", "l_suppkey")), F.lit(2000000000000000) + c("l_orderkey") * 10000000 + c("l_suppkey"), 4000000000 + c("l_orderkey"), 2000000000 + c("l_suppkey"), "type-use", c("l_orderkey")),
        rows(distinct(line.select("l_partkey", "l_suppkey")), F.lit(3000000000000000) + c("l_partkey") * 10000000 + c("l_suppkey"), 3000000000 + c("l_partkey"), 2000000000 + c("l_suppkey"), "import"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


VERTICES_SQL = """vertices AS (
  SELECT CAST(1 + r_regionkey AS BIGINT) AS vid, r_name AS name, 'region' AS type, 'world/' || r_name AS file FROM region
  UNION ALL SELECT 100 + n_nationkey, n_name, 'nation', 'world/' || n_name FROM nation
  UNION ALL SELECT 1000000000 + c_custkey, c_name, 'customer', 'customers/' || c_mktsegment || '/' || CAST(c_custkey % 20 AS VARCHAR) FROM customer
  UNION ALL SELECT 2000000000 + s_suppkey, s_name, 'supplier', 'suppliers/' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 3000000000 + p_partkey, p_name, 'part', 'parts/' || p_brand || '/' || p_type FROM part
  UNION ALL SELECT 4000000000 + o_orderkey, 'order ' || CAST(o_orderkey AS VARCHAR), 'order', 'orders/' || o_orderstatus || '/' || CAST(o_orderkey % 50 AS VARCHAR) FROM orders)"""


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """vid, name, type, file."""
    c = F.col

    def rows(t, vid, name, kind, file):
        return table(spark, sf, t).select(vid.cast("long").alias("vid"), name.alias("name"), F.lit(kind).alias("type"), file.alias("file"))

    s = lambda x: x.cast("string")
    parts = [
        rows("region", 1 + c("r_regionkey"), c("r_name"), "region", F.concat(F.lit("world/"), c("r_name"))),
        rows("nation", 100 + c("n_nationkey"), c("n_name"), "nation", F.concat(F.lit("world/"), c("n_name"))),
        rows("customer", 1000000000 + c("c_custkey"), c("c_name"), "customer", F.concat(F.lit("customers/"), c("c_mktsegment"), F.lit("/"), s(c("c_custkey") % 20))),
        rows("supplier", 2000000000 + c("s_suppkey"), c("s_name"), "supplier", F.concat(F.lit("suppliers/"), s(c("s_nationkey")))),
        rows("part", 3000000000 + c("p_partkey"), c("p_name"), "part", F.concat(F.lit("parts/"), c("p_brand"), F.lit("/"), c("p_type"))),
        rows("orders", 4000000000 + c("o_orderkey"), F.concat(F.lit("order "), s(c("o_orderkey"))), "order", F.concat(F.lit("orders/"), c("o_orderstatus"), F.lit("/"), s(c("o_orderkey") % 50))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SPANS_SQL = """spans AS (SELECT DISTINCT l_suppkey AS file, CAST(l_partkey % 700 AS BIGINT) AS s, CAST(l_partkey % 700 + l_quantity AS BIGINT) AS e, l_partkey * 100 + CAST(l_quantity AS BIGINT) AS id FROM lineitem)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Line spans (file, s, e, id): parts of each supplier."""
    q = F.col("l_quantity").cast("long")
    p = F.col("l_partkey")
    return distinct(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), (p % 700).alias("s"), (p % 700 + q).alias("e"), (p * 100 + q).alias("id")))


POINTS_SQL = """points AS (SELECT event_id, user_id % 100 AS file, event_id % 750 AS line FROM events)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", (F.col("user_id") % 100).alias("file"), (F.col("event_id") % 750).alias("line"))


CELLS_SQL = """cells AS (SELECT event_type AS arm, CAST(user_id AS BIGINT) AS query_id, event_id AS rep, value AS cost, event_id % 4 <> 0 AS success,
  CAST(event_id % 11 AS DOUBLE) / 10 AS recall, event_id % 9 AS turns, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 1000 END AS prompt, event_id % 100 AS completion FROM events)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation records: arm, query_id, rep, cost, success, recall, turns, prompt, completion."""
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("arm"), F.col("user_id").cast("long").alias("query_id"), i.alias("rep"), F.col("value").alias("cost"), (i % 4 != 0).alias("success"),
        ((i % 11).cast("double") / 10).alias("recall"), (i % 9).alias("turns"), F.when(i % 10 != 0, i % 1000).alias("prompt"), (i % 100).alias("completion"),
    )
