"""Vector retrieval: exact, masked, hierarchical, inverted-file, rerank, delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_l2(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, v: s + v * v)


def similarity(a, b, metric: str = "ip") -> Column:
    """``ip``: inner product; ``l2``: squared distance."""
    return dot(a, b) if metric == "ip" else squared_l2(a, b)


def search(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", metric: str = "ip", threshold: float | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Exact top-k against one query row (column ``embedding``), then the mask: it may leave fewer than k.

    The one-row query is broadcast; each partition keeps its own k best.
    """
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(q)).withColumn("score", similarity("embedding", "__q", metric)).drop("__q")
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold if metric == "ip" else F.col("score") <= threshold)
    best = scored.orderBy(F.desc("score") if metric == "ip" else F.asc("score"), key).limit(k)
    return best if mask is None else best.join(mask, key, "left_semi")


def search_within(vectors: DataFrame, query: DataFrame, ids: DataFrame, k: int, node: str = "node_id", key: str = "vec_id", metric: str = "ip") -> DataFrame:
    """Mask first, then score, the best row of each node, then cut."""
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    own = vectors.join(ids, node, "left_semi").crossJoin(F.broadcast(q)).withColumn("score", similarity("embedding", "__q", metric)).drop("__q", "embedding")
    value = F.col("score") if metric == "ip" else -F.col("score")
    best = own.groupBy(node).agg(F.max_by(F.struct("score", key), F.struct(value, -F.col(key))).alias("b")).select(node, "b.score", F.col(f"b.{key}").alias(key))
    return best.orderBy(F.desc("score") if metric == "ip" else F.asc("score"), key).limit(k)


def hierarchical(coarse: DataFrame, fine: DataFrame, query: DataFrame, k: int, file: str = "file", key: str = "vec_id") -> DataFrame:
    """The k coarse hits name files; of 3 k fine hits those in the files stay (all, if there were no coarse hits), cut to k."""
    files = search(coarse, query, k, key).select(file).distinct()
    hits = search(fine, query, 3 * k, key)
    empty = files.agg((F.count("*") == 0).alias("__none"))
    kept = hits.join(F.broadcast(files.withColumn("__in", F.lit(True))), file, "left").crossJoin(F.broadcast(empty)).filter(F.col("__none") | F.col("__in"))
    return kept.drop("__in", "__none").orderBy(F.desc("score"), key).limit(k)


def content_rerank(candidates: DataFrame, vectors: DataFrame, query: DataFrame, key: str, metric: str = "ip") -> DataFrame:
    """Candidates with content by inner product, or by negative (plain) distance; others go."""
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    own = candidates.filter(F.coalesce("content", F.lit("")) != "").drop("score").join(vectors.select(key, "embedding"), key).crossJoin(F.broadcast(q))
    score = dot("embedding", "__q") if metric == "ip" else -F.sqrt(squared_l2("embedding", "__q"))
    return own.withColumn("score", score).drop("__q", "embedding").orderBy(F.desc("score"), "rank")


def indexed_rerank(candidates: DataFrame, vectors: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """Candidates in the index by its score; the rest follow in their order."""
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    scored = vectors.join(candidates.select(key).distinct(), key, "left_semi").crossJoin(F.broadcast(q)).select(key, dot("embedding", "__q").alias("vector_score"))
    return candidates.join(scored, key, "left").withColumn("matched", F.col("vector_score").isNotNull()).orderBy(F.desc("matched"), F.desc("vector_score"), "rank")


def by_hash(rows: DataFrame, hash_col: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    return rows.groupBy(hash_col).agg(F.min_by(vector, key).alias(vector), F.min(key).alias(key))


def delta(old: DataFrame, new: DataFrame, hash_col: str, key: str, max_change: float = 0.1) -> tuple[DataFrame, Column]:
    """Multiset difference on the content hash: (key of old, key of new, state), and the expression of a rebuild.

    State: kept (takes the new row's metadata), removed or added. More than ``max_change`` of the old
    rows changed means a rebuild.
    """
    nth = F.row_number().over(W.partitionBy(hash_col).orderBy(key))
    a = old.select(hash_col, F.col(key).alias("old_key"), nth.alias("nth"))
    b = new.select(hash_col, F.col(key).alias("new_key"), nth.alias("nth"))
    state = F.when(F.col("new_key").isNull(), "removed").when(F.col("old_key").isNull(), "added").otherwise("kept")
    out = a.join(b, [hash_col, "nth"], "full_outer").withColumn("state", state)
    rebuild = F.sum((F.col("state") != "kept").cast("long")) > F.lit(max_change) * F.sum(F.col("old_key").isNotNull().cast("long"))
    return out, rebuild


def stats(vectors: DataFrame, level: str) -> DataFrame:
    return vectors.groupBy(level).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dim"))


def ivf_centroids(vectors: DataFrame, nlist: int = 16, rounds: int = 5, seed: int = 7, sample: int = 20_000) -> DataFrame:
    """Centroids of an inverted file, by k-means over a bounded sample of the rows smallest by hash."""
    import numpy as np

    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "list_id int, centroid array<double>")
    x = np.array([r.embedding for r in rows], float)
    c = x[np.random.default_rng(seed).permutation(len(x))[: min(nlist, len(x))]]
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list_id int, centroid array<double>")


def _nearest_list(vector, centroids) -> Column:
    """The list of the centroid nearest to a vector; ties to the first."""
    scores = F.transform(centroids, lambda c: dot(vector, c["centroid"]) - dot(c["centroid"], c["centroid"]) / 2)
    return F.transform(F.array(scores), lambda s: F.get(centroids, F.array_position(s, F.array_max(s)).cast("int") - 1)["list_id"])[0]


def ivf_assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` with the list_id of each: centroids go round as one row, so vectors stay where they lie."""
    whole = centroids.agg(F.sort_array(F.collect_list(F.struct("list_id", "centroid"))).alias("__c"))
    return vectors.crossJoin(F.broadcast(whole)).withColumn("list_id", _nearest_list("embedding", F.col("__c"))).drop("__c")


def write_ivf(vectors: DataFrame, centroids: DataFrame, path: str) -> None:
    """An inverted file stored by list. Written whole; it replaces what was there."""
    ivf_assign(vectors, centroids).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def ivf_stored(spark: SparkSession, path: str, query: DataFrame, k: int, nprobe: int = 4, key: str = "vec_id") -> DataFrame:
    """The ``k`` best of the ``nprobe`` lists nearest to a query; no other list is opened."""
    centroids = spark.read.parquet(f"{path}/centroids")
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    near = centroids.crossJoin(F.broadcast(q)).orderBy(F.desc(dot("centroid", "__q") - dot("centroid", "centroid") / 2), "list_id").limit(nprobe)
    probes = [r.list_id for r in near.select("list_id").collect()]  # nprobe numbers
    return search(spark.read.parquet(f"{path}/lists").filter(F.col("list_id").isin(probes)).drop("list_id"), query, k, key)


def ivf_search(vectors: DataFrame, centroids: DataFrame, query: DataFrame, k: int, nprobe: int = 4, key: str = "vec_id") -> DataFrame:
    """Vectors are assigned to their nearest centroid (a table of fixed size); a query visits ``nprobe`` lists."""
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    probes = centroids.crossJoin(F.broadcast(q)).orderBy(F.desc(dot("centroid", "__q") - dot("centroid", "centroid") / 2), "list_id").limit(nprobe).select("list_id")
    own = ivf_assign(vectors, centroids).join(F.broadcast(probes), "list_id", "left_semi").drop("list_id")
    return search(own, query, k, key)


def hashed_encoder(dim: int = 64, n: int = 3):
    """A stand-in for a model: unit vectors of hashed character n-grams. Equal texts give equal vectors, anywhere."""
    import zlib

    import numpy as np

    def encode(texts: list[str]):
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            data = f"^{t.lower()}$".encode("utf-8", "surrogatepass")
            for i in range(max(1, len(data) - n + 1)):
                h = zlib.crc32(data[i : i + n])
                row[h % dim] += 1.0 if h & 1 << 20 else -1.0
            size = float(np.sqrt((row * row).sum()))
            row /= size or 1.0
        return out

    return encode


def embed(rows: DataFrame, content: str, make_encoder, batch: int = 64, into: str = "embedding") -> DataFrame:
    """``rows`` with a vector of their content; null or blank content has none.

    ``make_encoder`` is called once in each Python worker's task, so that a model is loaded there and not sent; it
    returns a function from a list of texts to a matrix.
    """
    import pandas as pd

    def run(batches):
        encode = make_encoder()
        for texts in batches:
            out, own = [None] * len(texts), [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            for s in range(0, len(own), batch):
                part = own[s : s + batch]
                for i, v in zip(part, encode([texts.iloc[i] for i in part])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return rows.withColumn(into, F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)(F.col(content)))
