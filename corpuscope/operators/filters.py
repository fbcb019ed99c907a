"""Candidate predicates and bounded filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import paths

# Types of symbols.
SYMBOL_TYPES = ["class", "function", "method", "field", "interface", "struct", "enum", "variable"]


def has_span() -> Column:
    return F.col("file").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()


def has_content() -> Column:
    return F.coalesce(F.trim("content"), F.lit("")) != ""


def is_symbol() -> Column:
    return F.coalesce(F.col("type").isin(SYMBOL_TYPES), F.lit(False))


def candidate_filters(require_span=False, require_content=False, symbol_only=False, drop_tests=False, include_exts=None, exclude_globs=None) -> list[Column]:
    file = F.col("file")
    flags = [(require_span, has_span), (require_content, has_content), (symbol_only, is_symbol), (drop_tests, lambda: ~paths.is_test_path(file))]
    out = [make() for on, make in flags if on]
    out += [paths.include_extensions(file, include_exts)] if include_exts else []
    return out + ([paths.exclude_paths(file, exclude_globs)] if exclude_globs else [])


def filter_candidates(rows: DataFrame, predicates: list[Column], limit: int | None = None, order: str = "rank") -> DataFrame:
    for p in predicates:
        rows = rows.filter(p)
    return rows.orderBy(order).limit(limit) if limit is not None else rows


def score_threshold(rows: DataFrame, threshold: float, metric: str = "ip") -> DataFrame:
    return rows.filter(F.col("score") >= threshold if metric == "ip" else F.col("score") <= threshold)


def per_group(rows: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first k rows of each group."""
    from pyspark.sql import Window as W

    return rows.withColumn("n_in_group", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("n_in_group") <= k)


def percentile_picks(rows: DataFrame, group: str, order: list[str], shares=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Rows at fixed shares of each group's order; positions are rounded half to even."""
    from pyspark.sql import Window as W

    placed = rows.withColumn("i", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1).withColumn("n", F.count("*").over(W.partitionBy(group)))
    wanted = F.array_distinct(F.array(*[F.bround(F.lit(s) * (F.col("n") - 1)).cast("int") for s in shares]))
    return placed.filter(F.array_contains(wanted, F.col("i").cast("int")))


def round_robin_quota(rows: DataFrame, group: str, order: list[str], total: int) -> DataFrame:
    """The first ``total`` rows dealt in turn over the groups."""
    from pyspark.sql import Window as W

    dealt = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return dealt.orderBy("turn", group, *order).limit(total)


def in_scope(path: Column, target: str, allow_ancestors: bool = False, exclude: list[str] | None = None) -> Column:
    """In a target directory (or above it), visible, not excluded."""
    inside = (path == target) | path.startswith(target.rstrip("/") + "/")
    if allow_ancestors:
        inside = inside | F.concat(F.lit(target.rstrip("/") + "/")).startswith(F.concat(F.regexp_replace(path, "/?[^/]*$", ""), F.lit("/")))
    return inside & paths.is_visible(path) & paths.exclude_paths(path, exclude or [])


# Folders and suffixes of what corroborates an implementation rather than being one.
SUPPORTING_FOLDERS = ["benchmark", "benchmarks", "doc", "docs", "eval", "evaluation", "example", "examples", "experiment", "experiments", "sample", "samples", "scripts"]
DOCUMENT_SUFFIXES = [".adoc", ".md", ".rst"]


def is_supporting(path: Column) -> Column:
    """Tests, non-source files, documents, and files below a supporting folder; false without a path."""
    p = F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(""))
    below = F.lower(p).rlike("(^|/)(" + "|".join(SUPPORTING_FOLDERS) + ")/")
    document = F.lower(p).rlike("(" + "|".join(x.replace(".", r"\.") for x in DOCUMENT_SUFFIXES) + ")$")
    return (p != "") & (paths.is_test_file(p) | paths.is_non_source_file(p) | below | document)


def select_queries(rows: DataFrame, category: str, instance: str, order: str, categories: list[str] | None = None, max_instances: int | None = None, max_queries: int | None = None) -> DataFrame:
    """Rows of the wanted categories, of the first ``max_instances`` instances by ``order``, at most ``max_queries`` each."""
    from pyspark.sql import Window as W

    own = rows.filter(F.col(category).isin(categories)) if categories else rows
    if max_instances is not None:
        first = own.filter(F.col(instance).isNotNull()).groupBy(instance).agg(F.min(order).alias("__first")).orderBy("__first", instance).limit(max_instances)
        own = own.join(first.select(instance), instance, "left_semi")
    if max_queries is not None:
        own = own.withColumn("__n", F.row_number().over(W.partitionBy(instance).orderBy(order))).filter(F.col("__n") <= max_queries).drop("__n")
    return own
