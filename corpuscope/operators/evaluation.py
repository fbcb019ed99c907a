"""Evaluation aggregates: retrieval metrics, folding, costs, fronts, resampling, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics_at_k(predictions: DataFrame, targets: DataFrame, query: str, item: str, ks: list[int], distinct: bool = True) -> DataFrame:
    """Accuracy, precision and recall at each k for every query with targets.

    ``distinct`` keeps an item once, in rank order, before the cut; else repeats count in the denominator.
    Accuracy: all targets found. Queries without predictions count with zeros.
    """
    own = predictions
    if distinct:
        own = own.groupBy(query, item).agg(F.min("rank").alias("rank"))
        own = own.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy("rank", item)))
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    wanted = targets.select(query, item).distinct()
    hits = own.join(wanted, [query, item]).select(query, item, "rank", k).filter("rank <= k").groupBy(query, "k").agg(F.count_distinct(item).alias("hits"))
    given = own.select(query, "rank", k).filter("rank <= k").groupBy(query, "k").agg(F.count("*").alias("given"))
    base = wanted.groupBy(query).agg(F.count("*").alias("n")).select(query, "n", k)
    out = base.join(hits, [query, "k"], "left").join(given, [query, "k"], "left").fillna(0, ["hits", "given"])
    return out.select(query, "k", (F.col("hits") == F.col("n")).cast("long").alias("accuracy"), (F.col("hits") / F.greatest("given", F.lit(1))).alias("precision"), (F.col("hits") / F.col("n")).alias("recall"))


def mean_metrics(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))


def fold_repetitions(cells: DataFrame, by: list[str]) -> DataFrame:
    """Successful repetitions only: mean recall, least cost and turns."""
    return cells.filter("success").groupBy(*by).agg(F.avg("recall").alias("recall"), F.min("cost").alias("cost"), F.min("turns").alias("turns"), F.count("*").alias("reps"))


def arm_summary(cells: DataFrame, arm: str) -> DataFrame:
    return cells.groupBy(arm).agg(
        F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg(F.when(F.col("success"), F.col("cost"))).alias("mean_cost_success"),
        F.count_if(~F.col("success")).alias("failures"), F.percentile("cost", F.lit(0.5)).alias("median_cost"),
    )


def baseline_deltas(summary: DataFrame, arm: str, baseline: str, fields: list[str]) -> DataFrame:
    base = summary.filter(F.col(arm) == baseline).select(*[F.col(f).alias(f"__{f}") for f in fields])
    return summary.crossJoin(F.broadcast(base.limit(1))).select(arm, *[(F.col(f) - F.col(f"__{f}")).alias(f"delta_{f}") for f in fields])


def paired(cells: DataFrame, arm: str, a: str, b: str, key: list[str], value: str) -> DataFrame:
    """Values of two arms on the keys that both have."""
    x, y = cells.filter(F.col(arm) == a).select(*key, F.col(value).alias("a")), cells.filter(F.col(arm) == b).select(*key, F.col(value).alias("b"))
    return x.join(y, key)


def verdict(pairs: DataFrame, by: str | None = None, eps: float = 1e-9) -> DataFrame:
    """Wins, ties and losses of b over a, with the pooled row ``ALL``."""
    d = F.col("b") - F.col("a")
    counts = [F.sum(F.when(d > eps, 1).otherwise(0)).alias("wins"), F.sum(F.when(F.abs(d) <= eps, 1).otherwise(0)).alias("ties"), F.sum(F.when(d < -eps, 1).otherwise(0)).alias("losses"), F.avg(d).alias("mean_delta")]
    if by is None:
        return pairs.agg(*counts)
    return pairs.rollup(by).agg(*counts).withColumn(by, F.coalesce(by, F.lit("ALL")))


def pareto_front(rows: DataFrame, high: str, low: str, key: str) -> DataFrame:
    """Rows that none beats: nowhere as high for less, nor higher for as little. Sorted scan, no self-join.

    Ties in both values stay together.
    """
    best = rows.groupBy(low).agg(F.max(high).alias(high))
    before = F.max(high).over(W.orderBy(low).rowsBetween(W.unboundedPreceding, -1))
    front = best.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col(high) > F.col("__before"))).select(low, high)
    return rows.join(front, [low, high], "left_semi").select(key, high, low)


def constrained_optimum(rows: DataFrame, quality: str, floor: float, value: str, arm: str) -> DataFrame:
    """Least value among the arms of enough quality, and its share of the dearest one's."""
    own = rows.filter(F.col(quality) >= floor)
    return own.agg(F.min(F.struct(value, arm)).alias("m"), F.max(value).alias("most")).select(F.col(f"m.{arm}").alias(arm), F.col(f"m.{value}").alias(value), (F.col(f"m.{value}") / F.col("most")).alias("ratio"))


def token_accounting(cells: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Sums and coverage of each field; a total only where every row has the value."""
    out = []
    for f in fields:
        out += [F.sum(f).alias(f"sum_{f}"), (F.count(f) / F.count("*")).alias(f"coverage_{f}"), F.when(F.count(f) == F.count("*"), F.sum(f)).alias(f"total_{f}")]
    return cells.groupBy(by).agg(*out)


def price(cells: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """Cost by token class and rate for a million; a cached prompt's tokens are not counted twice; null without a rate."""
    plain = F.when(F.col("prompt_includes_cache"), F.greatest(F.col("prompt") - F.col("cached"), F.lit(0))).otherwise(F.col("prompt"))
    cost = (plain * F.col("rate_input") + F.col("cached") * F.col("rate_cached") + F.col("completion") * F.col("rate_output")) / 1e6
    return cells.join(rates, model, "left").withColumn("cost", cost)


def profile(rows: DataFrame, label: str, value: str) -> DataFrame:
    return rows.groupBy(label).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.stddev_pop(value).alias("std"),
    )


def index_percentile(values: Column, q: float) -> Column:
    """The element at the whole part of q times n of the sorted values; no interpolation."""
    s = F.sort_array(values)
    return F.element_at(s, F.least(F.floor(F.lit(q) * F.size(s)).cast("int") + 1, F.size(s)))


def bootstrap(deltas: DataFrame, key: str, value: str, rounds: int = 200, seed: int = 7, cluster: str | None = None) -> DataFrame:
    """Mean and 2.5 / 97.5 % bounds of resampled means (by whole clusters if given).

    Draws are hashes of seed, round and draw, so runs agree whatever the partitioning. They are many more than Spark's
    statistics say of a generated table, so they meet the units by a merge, never by a broadcast.
    """
    unit = cluster or key
    units = deltas.groupBy(unit).agg(F.sum(value).alias("s"), F.count("*").alias("n")).withColumn("i", F.row_number().over(W.orderBy(unit)) - 1)
    total = units.agg(F.count("*").alias("u"))
    each = deltas.sparkSession.range(1, rounds + 1).select(F.col("id").cast("int").alias("round")).crossJoin(F.broadcast(total.filter("u > 0")))  # one row
    draws = each.select("round", "u", F.explode(F.sequence(F.lit(1), F.col("u").cast("int"))).alias("draw"))
    picked = draws.select("round", F.pmod(F.xxhash64(F.lit(seed), "round", "draw"), F.col("u")).alias("i"))
    means = picked.hint("merge").join(units, "i").groupBy("round").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), index_percentile(F.collect_list("m"), 0.025).alias("low"), index_percentile(F.collect_list("m"), 0.975).alias("high"))


def non_inferior(bounds: DataFrame, margin: float) -> DataFrame:
    return bounds.withColumn("non_inferior", F.col("low") > -margin)


def commit_window(commits: DataFrame, order: str = "seq", seconds: str = "seconds") -> DataFrame:
    """First (cold) build, mean of the patched ones, speed-up or null."""
    cold = F.min_by(seconds, order)
    first = commits.agg(F.min(order).alias("first"))
    rows = commits.crossJoin(F.broadcast(first))
    out = rows.agg(cold.alias("cold"), F.avg(F.when(F.col(order) > F.col("first"), F.col(seconds))).alias("patched"))
    return out.withColumn("speedup", F.when(F.col("patched") > 0, F.col("cold") / F.col("patched")))


def replay_summary(rows: DataFrame, by: str) -> DataFrame:
    """Counts by status; percentiles of the equivalent requests alone."""
    ok = F.col("status") == "equivalent"
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(ok).alias("equivalent"), F.percentile(F.when(ok, F.col("static_ms")), F.lit(0.5)).alias("static_p50"), F.percentile(F.when(ok, F.col("live_ms")), F.lit(0.5)).alias("live_p50"))


def trace_latency(turns: DataFrame, conversation: str, order: str, at: str) -> DataFrame:
    """Seconds from each turn to the next."""
    later = F.lead(at).over(W.partitionBy(conversation).orderBy(order))
    return turns.withColumn("next_latency", F.unix_micros(later.cast("timestamp")) / 1e6 - F.unix_micros(F.col(at).cast("timestamp")) / 1e6)


def consensus(votes: DataFrame, query: str, run: str, block: str) -> DataFrame:
    """Blocks named by at least half of the runs, most votes first."""
    runs = votes.groupBy(query).agg(F.count_distinct(run).alias("runs"))
    n = votes.select(query, run, block).distinct().groupBy(query, block).agg(F.count("*").alias("votes"))
    return n.join(runs, query).filter(F.col("votes") >= F.ceil(F.col("runs") / 2)).select(query, block, "votes")


def best_run(votes: DataFrame, query: str, run: str, block: str) -> DataFrame:
    """The run whose blocks got the most votes in all; ties to the smaller run."""
    own = votes.select(query, run, block).distinct()
    n = own.groupBy(query, block).agg(F.count("*").alias("votes"))
    total = own.join(n, [query, block]).groupBy(query, run).agg(F.sum("votes").alias("total"))
    return total.groupBy(query).agg(F.min_by(run, F.struct((-F.col("total")).alias("t"), run)).alias(run), F.max("total").alias("total"))


def gate(rows: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Named counts against their minimums."""
    agg = rows.agg(*[F.sum(c).cast("double").alias(c) for c in minimums])
    checks = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value"), F.lit(float(m)).alias("minimum")) for c, m in minimums.items()])).alias("c")
    return agg.select(checks).select("c.*").withColumn("passed", F.col("value") >= F.col("minimum"))


def location_scores(predicted: DataFrame, truth: DataFrame, instances: DataFrame, key: str, item: str) -> DataFrame:
    """(key, match, precision): whether all true items were named, and the share of named ones that are true (1 if none was named)."""
    p, t = predicted.select(key, item).distinct(), truth.select(key, item).distinct()
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), [key, item], "full_outer")
    n = both.groupBy(key).agg(F.count("p").alias("named"), F.count("t").alias("true"), F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("hit"))
    own = instances.select(key).distinct().join(n, key, "left").fillna(0)
    return own.select(key, (F.col("hit") == F.col("true")).alias("match"), F.when(F.col("named") > 0, F.col("hit") / F.col("named")).otherwise(1.0).alias("precision"))


def location_summary(scores: DataFrame) -> DataFrame:
    """Counts and means over all instances, failed ones among them; rates are null without any."""
    return scores.agg(F.count("*").alias("n"), F.count_if("match").alias("matches"), F.avg(F.col("match").cast("double")).alias("match_rate"), F.avg("precision").alias("precision_mean"))


def nested_bootstrap(rows: DataFrame, levels: list[str], value: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Mean and 2.5 / 97.5 % bounds of means resampled level by level: clusters, then their members, then repetitions.

    Every level draws as many units as there are, with replacement, and weighs them alike. Draws are hashes of seed,
    round, place and draw, so runs agree whatever the partitioning. Only evaluation units are expanded, ``rounds`` times;
    draws meet them by a merge, as in ``bootstrap``.
    """
    numbered = rows.select(*levels, value)
    tree, path = None, []
    for level in levels:
        units = numbered.select(*path, level).distinct()
        order = W.partitionBy(*path) if path else W.partitionBy()
        units = units.withColumn("__i", F.row_number().over(order.orderBy(level)) - 1).withColumn("__n", F.count("*").over(order))
        if tree is None:
            tops = units.agg(F.count("*").alias("__size"))
            tree = rows.sparkSession.range(rounds).select(F.col("id").alias("__round"), F.lit("").alias("__place"), F.lit(1.0).alias("__w")).crossJoin(F.broadcast(tops))
        else:
            tree = tree.hint("merge").join(units.select(*path, F.col("__n").alias("__size")).distinct(), path)
        draws = tree.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.col("__size").cast("int")))).withColumn("__i", F.pmod(F.xxhash64(F.lit(seed), "__round", "__place", "__draw"), F.col("__size")).cast("int"))
        draws = draws.withColumn("__place", F.concat_ws("/", "__place", F.col("__draw").cast("string"))).withColumn("__w", F.col("__w") / F.col("__size"))
        tree = draws.drop("__size", "__draw").hint("merge").join(units.drop("__n"), [*path, "__i"]).drop("__i")
        path.append(level)
    means = tree.hint("merge").join(numbered.groupBy(*levels).agg(F.avg(value).alias("__v")), levels).groupBy("__round").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), index_percentile(F.collect_list("m"), 0.025).alias("low"), index_percentile(F.collect_list("m"), 0.975).alias("high"))
