"""Ranked-list algebra. Input rows: branch, rank (from 1), key columns, score, content, file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def node_key(node_id: Column, file: Column, start: Column, end: Column) -> Column:
    span = F.concat_ws(":", file, start.cast("string"), end.cast("string"))
    return F.when(F.coalesce(node_id, F.lit("")) != "", node_id).otherwise(span)


def file_key(node_id: Column, file: Column) -> Column:
    """The relative path in the node id where the file ends with it, else the file."""
    relative = F.substring_index(node_id, ":", 1)
    return F.when(node_id.contains(":") & (relative != "") & file.endswith(relative), relative).otherwise(F.coalesce(file, relative))


def normalize_results(rows: DataFrame) -> DataFrame:
    """A missing or zero score becomes 1 / rank."""
    return rows.withColumn("score", F.when(F.coalesce("score", F.lit(0.0)) == 0, 1.0 / F.col("rank")).otherwise(F.col("score")))


def _seen(branch: str = "branch", rank: str = "rank") -> Column:
    return F.struct(F.col(branch), F.col(rank))


def fuse(rows: DataFrame, key: str, method: str = "weighted", weights: dict | None = None, k: int = 60, base: int = 1) -> DataFrame:
    """One fused list: (key, score, branch and rank first seen, content), best first by score, then first seen.

    ``weighted`` (also linear, linear_combination, weighted_sum, none): sum of weight times score, a missing
    or zero score counting as 1 / (rank + base - 1). ``rrf``: sum of weight / (k + rank); a key that repeats
    in a branch counts again.
    """
    if method in ("linear", "linear_combination", "weighted_sum", "none", "weighted"):
        own = F.when(F.coalesce("score", F.lit(0.0)) == 0, 1.0 / (F.col("rank") + (base - 1))).otherwise(F.col("score"))
    elif method == "rrf":
        own = 1.0 / (k + F.col("rank"))
    else:
        raise ValueError(f"unknown fusion method: {method}")
    weight = F.lit(1.0)
    for b, w in (weights or {}).items():
        weight = F.when(F.col("branch") == b, float(w)).otherwise(weight)
    out = rows.withColumn("__own", weight * own).groupBy(key).agg(
        F.sum("__own").alias("score"),
        F.min(_seen()).alias("first"),
        F.min_by("content", F.when(F.coalesce("content", F.lit("")) != "", _seen())).alias("content"),
    )
    return out.select(key, "score", F.col("first.branch").alias("branch"), F.col("first.rank").alias("rank"), "content")


def ranked(rows: DataFrame, *order, into: str = "position") -> DataFrame:
    """Global ranks of a list that is already cut to a bounded size."""
    return rows.withColumn(into, F.row_number().over(W.orderBy(*order)))


def top_k(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def fuse_by_file(rows: DataFrame, weights: dict | None = None, k: int = 60) -> DataFrame:
    """Reciprocal ranks of files: each branch keeps a file once, and ranks are counted anew."""
    once = rows.groupBy("branch", "file").agg(F.min("rank").alias("rank"), F.min_by("content", "rank").alias("content"))
    again = once.withColumn("rank", F.row_number().over(W.partitionBy("branch").orderBy("rank")))
    return fuse(again.withColumn("score", F.lit(None).cast("double")), "file", "rrf", weights, k)


def dedup(rows: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """First row of each key; a later one may lend its content."""
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != "content"]), F.col(order)).alias("row")
    content = F.min_by("content", F.when(F.coalesce("content", F.lit("")) != "", F.col(order))).alias("content")
    return rows.groupBy(F.col(key).alias("__key")).agg(first, content).select("row.*", "content")


def provenance_rrf(rows: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Once for each route, unweighted; keeps the routes."""
    once = rows.groupBy(key, "branch").agg(F.min("rank").alias("rank"))
    return once.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("first_rank"), F.sort_array(F.collect_set("branch")).alias("routes"))


def diversify(rows: DataFrame, group: str, per_group: int, limit: int, order: str = "rank") -> DataFrame:
    """At most ``per_group`` rows of a group first; those put off fill up to ``limit``."""
    place = F.row_number().over(W.partitionBy(group).orderBy(order))
    put_off = (place > per_group).cast("int")
    return rows.withColumn("put_off", put_off).orderBy("put_off", order).limit(limit)


def interleave(rows: DataFrame, key: str, source: str = "branch") -> DataFrame:
    """Round robin over sources; a key is kept where it comes first."""
    return rows.groupBy(key).agg(F.min(F.struct("rank", source)).alias("at")).select(key, F.col("at.rank").alias("rank"), F.col(f"at.{source}").alias(source))


def branch_coverage(fused: DataFrame, rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Top half of the fused list, then one hit that only its branch has from each branch, then the rest."""
    alone = rows.groupBy(key).agg(F.count_distinct("branch").alias("branches"), F.min("branch").alias("only"))
    placed = fused.join(alone, key).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), key)))
    exclusive = (F.col("branches") == 1) & (F.col("place") > limit // 2)
    nth = F.row_number().over(W.partitionBy(F.when(exclusive, F.col("only"))).orderBy("place"))
    tier = F.when(F.col("place") <= limit // 2, 0).when(exclusive & (nth == 1), 1).otherwise(2)
    return placed.withColumn("tier", tier).orderBy("tier", "place").limit(limit)


def interval_union(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Merged intervals of each group; those that touch (start <= end + 1) become one."""
    order = W.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)
    island = F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("__new", new).withColumn("__island", island)
    return marked.groupBy(group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def content_budget(rows: DataFrame, group: str, total: int, least: int, order: str = "rank", text: str = "content") -> DataFrame:
    """Admit total / least rows of a group, split the budget equally (the last takes what is left over), cut their texts."""
    size = F.count("*").over(W.partitionBy(group))
    admitted = F.least(size, F.lit(total // least))
    place = F.row_number().over(W.partitionBy(group).orderBy(order))
    share = F.expr(f"{total} div admitted") + F.when(F.col("place") == F.col("admitted"), F.expr(f"{total} % admitted")).otherwise(0)
    out = rows.withColumn("admitted", admitted.cast("int")).withColumn("place", place).filter("place <= admitted").withColumn("allowance", share.cast("int"))
    return out.withColumn("projected", F.substring(F.col(text), F.lit(1), F.col("allowance")))


def window_rerank(rows: DataFrame, size: int, step: int, scorer: Column, order: str = "rank") -> DataFrame:
    """Listwise rerank over sliding windows: the score of a row is its mean over the windows that hold it."""
    last = F.max(order).over(W.partitionBy("branch"))
    placed = rows.withColumn("__n", last)
    begins = F.expr(f"filter(sequence(1, greatest(__n, 1), {step}), s -> s <= {order} and {order} < s + {size})")
    spread = placed.withColumn("window_start", F.explode(begins)).withColumn("__s", scorer)
    return spread.groupBy("branch", order).agg(F.avg("__s").alias("score"), F.count("*").alias("windows"))


def parse_permutation(answer: Column, n: Column) -> Column:
    """Zero-based order from a ranking answer: numbers in range, each once, those missing at the end."""
    said = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("[0-9]{1,9}"), F.lit(0)), lambda x: x.cast("int") - 1)
    valid = F.array_distinct(F.filter(said, lambda x: (x >= 0) & (x < n)))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(valid, F.array_except(every, valid))


def run_stages(stages: list[tuple[str, DataFrame]], key: str, top_k: int, fusion: str = "weighted", weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """The results of retrieval stages (name, rows with rank, score and content): one list is cut, several are fused.

    Weights count if there is one for each stage, else all stages count alike.
    """
    if not stages or top_k <= 0:
        raise ValueError("a stage at least, and a positive top_k")
    if len(stages) == 1:
        return stages[0][1].orderBy("rank").limit(top_k).select(key, "score")
    rows = None
    for i, (_, own) in enumerate(stages):
        part = own.select(F.lit(i).cast("long").alias("branch"), F.col("rank").cast("long").alias("rank"), key, "score", "content")
        rows = part if rows is None else rows.unionByName(part)
    own_weights = dict(enumerate(weights)) if weights is not None and len(weights) == len(stages) else {}
    return fuse(rows, key, fusion, own_weights, k).orderBy(F.desc("score"), "branch", "rank", key).limit(top_k).select(key, "score")
