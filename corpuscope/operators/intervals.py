"""Interval joins and span evaluation. Lines are whole numbers; ends are included unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.session import checkpoint, parts

#: Lines of one bucket: both sides of a range join meet in the buckets that they touch, hashed by file and bucket.
BUCKET = 64


def _bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET))))


def overlap_join(left: DataFrame, right: DataFrame, file: str, ls: str, le: str, rs: str, re_: str) -> DataFrame:
    """Pairs of one file whose intervals meet; each pair once, from the first bucket that both touch."""
    a, b = _bucketed(left, ls, le), _bucketed(right, rs, re_)
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / BUCKET)
    return a.join(b, [file, "__bucket"]).filter((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)) & (F.col("__bucket") == first)).drop("__bucket")


def _holding(points: DataFrame, spans: DataFrame, file: str, at: str, start: str, end: str) -> DataFrame:
    """Points with each span that holds them. Both sides are dealt out in parts whose number grows with the tables."""
    own, other = points.withColumn("__bucket", F.floor(F.col(at) / BUCKET)), _bucketed(spans, start, end)
    n = parts(points, spans)
    own, other = (x.repartition(*([n] if n else []), file, "__bucket") for x in (own, other))
    return own.join(other, [file, "__bucket"]).filter(F.col(at).between(F.col(start), F.col(end)))


def innermost(points: DataFrame, spans: DataFrame, file: str, at: str, start: str, end: str, key: str, tie: str) -> DataFrame:
    """For each point the span that holds it: one that begins exactly there, else the shortest, then by ``tie``; null if none."""
    hits = _holding(points, spans, file, at, start, end)
    order = F.struct((F.col(start) != F.col(at)).cast("int").alias("a"), (F.col(end) - F.col(start)).alias("b"), F.col(tie).alias("c"))
    best = hits.groupBy(key).agg(F.min_by(F.col(tie), order).alias("scope"))
    return points.join(best, key, "left")


def narrowest(points: DataFrame, spans: DataFrame, file: str, at: str, start: str, end: str, key: str, tie: str) -> DataFrame:
    """As ``innermost``, by (length, later start, id)."""
    hits = _holding(points, spans, file, at, start, end)
    order = F.struct((F.col(end) - F.col(start)).alias("a"), (-F.col(start)).alias("b"), F.col(tie).alias("c"))
    return hits.groupBy(key).agg(F.min_by(F.col(tie), order).alias("entity"))


def occurrence_at(points: DataFrame, occurrences: DataFrame, key: str) -> DataFrame:
    """First occurrence (by span order) that holds a position; columns file, line, char against half-open spans."""
    place = lambda line, char: F.col(line).cast("long") * (1 << 20) + F.col(char)
    p = points.withColumn("__at", place("line", "char")).withColumn("__line", F.col("line"))
    o = occurrences.withColumn("__from", place("start_line", "start_char")).withColumn("__to", place("end_line", "end_char"))
    o = o.withColumn("__line", F.explode(F.sequence("start_line", "end_line")))
    hits = p.join(o, ["file", "__line"]).filter((F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to")))
    return hits.groupBy(key).agg(F.min_by("symbol", F.struct("__from", "__to", "symbol")).alias("symbol"))


def locations(found: DataFrame, occurrences: DataFrame, key: str, definitions: bool, limit: int) -> DataFrame:
    """Definition or reference places of found symbols: distinct, sorted, cut. Symbols ``local ...`` stay in their file."""
    bit = F.col("roles").bitwiseAND(1) == (1 if definitions else 0)
    order = ["file", "start_line", "start_char"]
    places = occurrences.filter(bit).select("symbol", *order).distinct()
    # of a symbol's places no more than ``limit`` can be among the first of a key: cut before the join, not after it
    first = places.withColumn("__n", F.row_number().over(W.partitionBy("symbol").orderBy(*order))).filter(F.col("__n") <= limit).drop("__n")
    rows = found.select(key, "symbol").distinct().join(first, "symbol")
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("n") <= limit).select(key, "symbol", *order, "n")


def normalize_span(df: DataFrame, start: str, end: str, base: int = 1) -> DataFrame:
    """To base 0; reversed ends are swapped; rows without both ends go."""
    a, b = F.expr(f"try_cast({start} as long)") - base, F.expr(f"try_cast({end} as long)") - base
    return df.withColumn("s", F.least(a, b)).withColumn("e", F.greatest(a, b)).filter(a.isNotNull() & b.isNotNull() & (F.least(a, b) >= 0))


def greedy_dedup(df: DataFrame, query: str, rank: str, file: str, start: str, end: str) -> DataFrame:
    """In rank order, drop a span that meets one already kept. Kept spans alone count, so order matters:
    each query's ranked list is folded."""
    items = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(file).alias("f"), F.col(start).alias("s"), F.col(end).alias("e"))))

    def step(acc, x):
        return F.when(F.exists(acc, lambda y: (y["f"] == x["f"]) & (y["s"] <= x["e"]) & (x["s"] <= y["e"])), acc).otherwise(F.concat(acc, F.array(x)))

    grouped = df.groupBy(query).agg(items.alias("__i"))
    empty = F.filter("__i", lambda x: F.lit(False))
    return grouped.select(query, F.explode(F.aggregate("__i", empty, step)).alias("x")).select(query, F.col("x.r").alias(rank), F.col("x.f").alias(file), F.col("x.s").alias(start), F.col("x.e").alias(end))


def block_metrics(predictions: DataFrame, truth: DataFrame, query: str, ks: list[int]) -> DataFrame:
    """Recall of truth blocks and precision of predicted spans at each k, by overlap; no truth means zeros."""
    p = predictions.select(query, "rank", "file", F.col("s").alias("ps"), F.col("e").alias("pe"))
    t = truth.select(query, "file", F.col("s").alias("ts"), F.col("e").alias("te"), "block")
    hits = p.join(t, [query, "file"]).filter("ps <= te and ts <= pe").select(query, "rank", "block")
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    counted = hits.select(query, "rank", "block", k).filter("rank <= k").groupBy(query, "k").agg(F.count_distinct("block").alias("blocks"), F.count_distinct("rank").alias("on_target"))
    base = truth.groupBy(query).agg(F.count_distinct("block").alias("n_truth")).select(query, "n_truth", k)
    given = predictions.select(query, "rank", k).filter("rank <= k").groupBy(query, "k").agg(F.count("*").alias("n_given"))
    out = base.join(counted, [query, "k"], "left").join(given, [query, "k"], "left").fillna(0, ["blocks", "on_target", "n_given"])
    return out.select(query, "k", (F.col("blocks") / F.col("n_truth")).alias("recall"), (F.col("on_target") / F.greatest("n_given", F.lit(1))).alias("precision"))


def line_budget_ndcg(regions: DataFrame, core: DataFrame, query: str, budget: int) -> DataFrame:
    """Discounted gain of ranked regions until the line budget is passed (the first region always counts), over the ideal.

    Gain: core lines in the region times their weight. Ideal: by gain for each line.
    """
    c = core.select(query, "file", F.col("s").alias("cs"), F.col("e").alias("ce"), "weight")
    r = regions.withColumn("lines", F.col("e") - F.col("s") + 1)
    gained = r.join(c, [query, "file"], "left").withColumn("g", F.greatest(F.least("e", "ce") - F.greatest("s", "cs") + 1, F.lit(0)) * F.col("weight"))
    gained = gained.groupBy(query, "rank", "lines").agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("gain"))

    def dcg(df, order, into):
        w = W.partitionBy(query).orderBy(*order)
        placed = df.withColumn("i", F.row_number().over(w)).withColumn("used", F.sum("lines").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return placed.filter((F.col("used") <= budget) | (F.col("i") == 1)).groupBy(query).agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1)).alias(into))

    ideal = dcg(gained, [F.desc(F.col("gain") / F.col("lines")), "rank"], "ideal")
    out = dcg(gained, ["rank"], "dcg").join(ideal, query)
    return out.select(query, "dcg", F.when(F.col("ideal") > 0, F.least(F.col("dcg") / F.col("ideal"), F.lit(1.0))).otherwise(0.0).alias("ndcg"))


def disjoint(df: DataFrame, *keys: str) -> DataFrame:
    """The union of each key's intervals ``s`` to ``e`` as intervals that do not meet."""
    order = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    own = df.select(*keys, "s", "e").filter("s <= e").withColumn("__new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    own = own.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy(*keys, "__run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__run")


def common_lines(rows: DataFrame, cover: DataFrame, keys: list[str], into: str) -> DataFrame:
    """``rows`` (with ``s`` and ``e``, null for none) with how many of its lines lie in ``cover``, disjoint intervals of the same keys."""
    c = cover.select(*keys, F.col("s").alias("__cs"), F.col("e").alias("__ce"))
    columns = rows.columns
    own = rows.withColumn("__row", F.monotonically_increasing_id()) if "rank" not in columns else rows
    by = columns + [c for c in own.columns if c not in columns]
    shared = F.when(F.col("__cs").isNotNull(), F.greatest(F.least("e", "__ce") - F.greatest("s", "__cs") + 1, F.lit(0)))  # a reversed interval has none
    meets = [F.col(f"r.{k}") == F.col(f"c.{k}") for k in keys] + [F.col("s") <= F.col("__ce"), F.col("__cs") <= F.col("e")]
    hit = own.alias("r").join(c.alias("c"), meets, "left")
    out = hit.groupBy(*[F.col(f"r.{x}") for x in by]).agg(F.coalesce(F.sum(shared), F.lit(0)).alias(into))
    return out.drop("__row")


def line_budget_recall(regions: DataFrame, core: DataFrame, query: str, budget: int) -> DataFrame:
    """Share of core lines among the first ``budget`` lines of the ranked regions, by interval arithmetic."""
    w = W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    r = regions.withColumn("before", F.coalesce(F.sum(F.greatest(F.col("e") - F.col("s") + 1, F.lit(0))).over(w), F.lit(0))).filter(F.col("before") < budget)
    r = r.withColumn("e", F.least(F.col("e"), F.col("s") + budget - F.col("before") - 1))
    keys = [query, "file"]
    wanted = disjoint(core, *keys)
    hit = common_lines(disjoint(r, *keys), wanted, keys, "hit").groupBy(query).agg(F.sum("hit").alias("hit"))
    total = wanted.groupBy(query).agg(F.sum(F.col("e") - F.col("s") + 1).alias("total"))
    return total.join(hit, query, "left").select(query, (F.coalesce("hit", F.lit(0)) / F.col("total")).alias("recall"))


def resolve_regions(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Regions (file, start, end; lines from 1) with ``s`` and ``e``: a negative start counts from the file's end, an end of -1 is its last line.

    Those that need a length that ``lengths`` (file, n_lines) has not, or end before the file, get nulls.
    """
    own = regions.join(lengths.select("file", "n_lines"), "file", "left")
    open_ = (F.col("end") == -1) | (F.col("start") < 0)
    known = F.col("n_lines") >= 1
    inside = lambda x: F.greatest(F.lit(1), F.least(x, F.col("n_lines")))
    s = F.when(open_ & known, inside(F.when(F.col("start") < 0, F.col("n_lines") + F.col("start") + 1).otherwise(F.col("start")))).when(~open_ & (F.col("end") >= 1), F.greatest(F.lit(1), F.col("start")))
    e = F.when(open_ & known, inside(F.when(F.col("end") == -1, F.col("n_lines")).otherwise(F.col("end")))).when(~open_ & (F.col("end") >= 1), F.col("end"))
    return own.withColumn("s", s.cast("long")).withColumn("e", e.cast("long")).drop("n_lines")


# The metrics of retrieved context, in order; line budgets; weights of a file that is central.
CONTEXT_METRICS = [
    "precision", "recall", "f1_score", "hit_file_rate", "noise_file_rate", "hit_region_rate", "noise_region_rate", "weighted_core_coverage", "context_efficiency", "optional_coverage",
    "ndcg_at_100", "ndcg_at_300", "ndcg_at_500", "recall_at_100", "recall_at_300", "recall_at_500", "first_useful_hit",
]
LINE_BUDGETS = [100, 300, 500]
CORE_WEIGHT, MAIN_CORE_WEIGHT, MAIN_GAIN = 2.0, 3.0, 1.5


def context_metrics(regions: DataFrame, core: DataFrame, optional: DataFrame, files: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """All of ``CONTEXT_METRICS`` for each query of ``regions``.

    ``regions``: query, rank from 1, file, start, end (lines from 1). ``core`` and ``optional`` regions: query,
    file, start, end. ``files``: query, file, role (core, optional or main). ``lengths``: file, n_lines. Lines are
    counted by interval arithmetic on disjoint unions; none is spread out. A rate of nothing is 0.
    """
    keys = [query, "file"]
    p, c, o = (resolve_regions(x, lengths) for x in (regions, core, optional))
    numbered = lambda x: x.withColumn("rank", F.monotonically_increasing_id())
    c, o = checkpoint(numbered(c)), checkpoint(numbered(o))
    pu, cu, ou, co = disjoint(p, *keys), disjoint(c, *keys), disjoint(o, *keys), disjoint(c.unionByName(o), *keys)
    pu, cu, ou = checkpoint(pu), checkpoint(cu), checkpoint(ou)
    size = F.sum(F.col("e") - F.col("s") + 1)
    by = lambda df, value, name: df.groupBy(query).agg(value.alias(name))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    tables = [
        by(pu, size, "n_p"), by(cu, size, "n_c"), by(ou, size, "n_o"),
        by(common_lines(pu, cu, keys, "n"), F.sum("n"), "n_pc"), by(common_lines(pu, ou, keys, "n"), F.sum("n"), "n_po"), by(common_lines(pu, co, keys, "n"), F.sum("n"), "n_pco"),
    ]
    # files
    seen = regions.select(*keys).distinct().withColumn("seen", F.lit(1))
    roles = files.groupBy(*keys).agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in ("core", "optional", "main")])
    each = roles.join(seen, keys, "full_outer").fillna(0)
    tables.append(each.groupBy(query).agg(F.sum("seen").alias("f_seen"), F.sum("core").alias("f_core"), F.sum(F.col("seen") * F.col("core")).alias("f_hit"), F.sum(F.when((F.col("seen") == 1) & (F.col("core") + F.col("optional") == 0), 1).otherwise(0)).alias("f_noise")))
    # regions
    main = roles.filter("main = 1").select(*keys, F.lit(True).alias("main"))
    hit_c = common_lines(c, pu, keys, "n").join(main, keys, "left")
    weight = F.when(F.col("main"), MAIN_CORE_WEIGHT).otherwise(CORE_WEIGHT)
    # a reversed interval has a weight and no line
    covered = F.when(F.col("e") >= F.col("s"), weight * F.col("n") / (F.col("e") - F.col("s") + 1)).otherwise(0.0)
    tables.append(hit_c.groupBy(query).agg(F.count("*").alias("r_core"), F.count_if(F.col("n") > 0).alias("r_hit"), F.sum(F.when(F.col("s").isNotNull(), covered)).alias("w_hit"), F.sum(F.when(F.col("s").isNotNull(), weight)).alias("w_all")))
    gained = common_lines(common_lines(p, co, keys, "known"), cu, keys, "gain").join(main, keys, "left")
    gained = checkpoint(gained.withColumn("lines", F.coalesce(F.greatest(F.col("e") - F.col("s") + 1, F.lit(0)), F.lit(0))))
    tables.append(gained.groupBy(query).agg(F.count("*").alias("r_all"), F.count_if(F.col("known") == 0).alias("r_noise"), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first")))
    gained = gained.withColumn("gain", F.col("gain") * F.when(F.col("main"), MAIN_GAIN).otherwise(1.0))

    def dcg(order, into):
        w = W.partitionBy(query).orderBy(*order)
        placed = gained.withColumn("i", F.row_number().over(w)).withColumn("used", F.sum("lines").over(w.rowsBetween(W.unboundedPreceding, 0)))
        value = lambda n: F.sum(F.when((F.col("used") <= n) | (F.col("i") == 1), F.col("gain") / F.log2(F.col("i") + 1)))
        return placed.groupBy(query).agg(*[value(n).alias(f"{into}_{n}") for n in LINE_BUDGETS])

    tables += [dcg(["rank"], "dcg"), dcg([F.desc(F.col("gain") / F.greatest("lines", F.lit(1))), "rank"], "ideal")]
    tables += [line_budget_recall(p.filter("s is not null"), cu, query, n).withColumnRenamed("recall", f"recall_at_{n}") for n in LINE_BUDGETS]
    out = regions.select(query).distinct()
    for t in tables:
        out = out.join(t, query, "left")
    out = out.fillna(0, [x for x in out.columns if x not in (query, "first")])
    out = out.withColumn("precision", rate("n_pc", "n_p")).withColumn("recall", rate("n_pc", "n_c"))
    pr = F.col("precision") + F.col("recall")
    ndcg = [F.when((F.col("n_c") > 0) & (F.col(f"ideal_{n}") > 0), F.least(F.col(f"dcg_{n}") / F.col(f"ideal_{n}"), F.lit(1.0))).otherwise(0.0).alias(f"ndcg_at_{n}") for n in LINE_BUDGETS]
    out = out.select(
        query, "precision", "recall", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0).alias("f1_score"), rate("f_hit", "f_core").alias("hit_file_rate"), rate("f_noise", "f_seen").alias("noise_file_rate"),
        rate("r_hit", "r_core").alias("hit_region_rate"), rate("r_noise", "r_all").alias("noise_region_rate"), rate("w_hit", "w_all").alias("weighted_core_coverage"), rate("n_pco", "n_p").alias("context_efficiency"), rate("n_po", "n_o").alias("optional_coverage"),
        *ndcg, *[f"recall_at_{n}" for n in LINE_BUDGETS], F.when(F.col("first").isNotNull(), 1 - (F.col("first") - 1) / F.col("r_all")).otherwise(0.0).alias("first_useful_hit"),
    )
    return out.select(query, *CONTEXT_METRICS)


def split_by_lines(df: DataFrame, start: str, end: str, limit: int) -> DataFrame:
    """Pieces of at most ``limit`` lines whose sizes differ by one at most, the larger ones first."""
    total = F.col(end) - F.col(start) + 1
    own = df.withColumn("__n", F.ceil(total / limit).cast("int")).withColumn("__base", F.expr(f"({end} - {start} + 1) div __n")).withColumn("__extra", total % F.col("__n"))
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    first = F.col(start) + F.col("piece") * F.col("__base") + F.least(F.col("piece"), F.col("__extra"))
    size = F.col("__base") + (F.col("piece") < F.col("__extra")).cast("int")
    return own.withColumn("piece_start", first).withColumn("piece_end", first + size - 1).drop("__n", "__base", "__extra")


def diff_ranges(diff: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, file, s, e): changed ranges on the new side of unified diffs, lines from 1; pure deletions are left out."""
    lines = diff.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    file = F.when(F.col("line").rlike(r"^\+\+\+ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))
    order = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    named = lines.withColumn("file", F.last(file, ignorenulls=True).over(order)).filter(F.col("line").startswith("@@"))
    pat = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    s, n = F.regexp_extract("line", pat, 1).cast("long"), F.regexp_extract("line", pat, 2)
    size = F.when(n == "", 1).otherwise(n.try_cast("long")) if hasattr(n, "try_cast") else F.when(n == "", 1).otherwise(n.cast("long"))
    return named.select(key, "file", s.alias("s"), (s + size - 1).alias("e")).filter("e >= s and file <> '/dev/null'")


def parse_answer(answer: Column) -> Column:
    """Files, with optional lines or symbols, named in a free-form answer."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"[\w./-]+\.[A-Za-z]+(?::[\w.]+)?"), F.lit(0)))


def hunks(diff: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, n, old_start, old_end, new_start, new_end): changed lines of both sides of diffs without context, from 0, ends included.

    A side without lines is a mark: the line before the change, 0 at least.
    """
    lines = diff.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), F.lit(0))).alias("n", "h"))
    part = lambda i: F.regexp_extract("h", r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    number = lambda i: F.when(part(i) == "", 1).otherwise(F.expr("0") + F.nullif(part(i), F.lit("")).cast("int"))

    def side(i):
        start, size = part(i).cast("int") - 1, number(i + 1)
        mark = F.greatest(F.lit(0), start - 1)
        return F.when(size == 0, mark).otherwise(start), F.when(size == 0, mark).otherwise(start + size - 1)

    (a, b), (c, d) = side(1), side(3)
    return lines.select(key, F.col("n").cast("long").alias("n"), *[x.cast("long").alias(k) for x, k in ((a, "old_start"), (b, "old_end"), (c, "new_start"), (d, "new_end"))])


def node_spans(nodes: DataFrame) -> DataFrame:
    """Spans of retrieved nodes (node_id, file, start_line, end_line, score), lines from 1, best score first in ``place``.

    The path in the node id goes before the file. Reversed ends are swapped; nodes without a path or ends go.
    """
    path = F.when(F.col("node_id").contains(":"), F.substring_index("node_id", ":", 1))
    own = nodes.withColumn("file", F.coalesce(F.when(path != "", path), "file")).filter("file is not null and start_line is not null and end_line is not null")
    own = own.withColumn("s", F.least("start_line", "end_line") + 1).withColumn("e", F.greatest("start_line", "end_line") + 1).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return own.filter("s >= 1").select("node_id", "file", "s", "e", "score")


def symbol_spans(answers: DataFrame, index: DataFrame) -> DataFrame:
    """Spans of the symbols that answers (key, symbol: ``path:Outer.name(args)``) name, by (file, leaf) in ``index`` (file, leaf, s, e)."""
    leaf = F.regexp_extract(F.substring_index(F.expr("substring(symbol, instr(symbol, ':') + 1)"), "(", 1), r"([^./]*)$", 1)
    own = answers.filter(F.col("symbol").contains(":")).withColumn("file", F.substring_index("symbol", ":", 1)).withColumn("leaf", F.trim(leaf))
    return own.join(index, ["file", "leaf"]).select(*[c for c in answers.columns], "file", "s", "e")
