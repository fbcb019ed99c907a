"""Lexical retrieval: postings, BM25, identifiers, patterns, trigrams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import paths, text
from corpuscope.session import checkpoint, dealt, spread


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each (node_id, start_line, end_line), the first by position; rows without an id go."""
    own = chunks.filter(F.coalesce("node_id", F.lit("")) != "")
    return own.groupBy("node_id", "start_line", "end_line").agg(F.min_by(F.struct(*own.columns), "position").alias("r")).select("r.*")


#: Files of a stored index that terms (or trigrams) are dealt to by hash.
BUCKETS = 64


def postings(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, term, tf, dl): one shuffle, of the texts by key, in parts by their size; the terms of a part are counted where it is."""
    own = dealt(docs.select(key, content), key).select(key, text.code_tokens(F.col(content)).alias("tokens"))
    terms = own.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _weights(stats: DataFrame, query: list[str], epsilon: float) -> DataFrame:
    """(term, weight, avgdl) of a query's terms, from (term, df, n, tokens): the same corpus totals in each row.

    Negative idf becomes ``epsilon`` times the vocabulary's mean; repeated query terms count again.
    """
    idf = stats.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"), (F.col("tokens") / F.col("n")).alias("avgdl"))
    floor = idf.agg((F.avg("idf") * epsilon).alias("floor"))
    times = F.create_map(*[F.lit(x) for t in sorted(set(query)) for x in (t, float(query.count(t)))])
    wanted = idf.filter(F.col("term").isin(sorted(set(query)))).crossJoin(F.broadcast(floor))  # one row
    return wanted.select("term", (times[F.col("term")] * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("weight"), "avgdl")


def _scored(hits: DataFrame, key: str, k1: float, b: float) -> DataFrame:
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # in order of the terms, one row each: equal texts have equal scores to the last bit, and ties fall to the key
    parts = F.sort_array(F.collect_list(F.struct("term", part.alias("part"))))
    return hits.groupBy(key).agg(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["part"]).alias("score"))


def term_stats(docs: DataFrame, content: str) -> DataFrame:
    """(term, df, n, tokens): document counts of terms, and in each row the number of documents and of all tokens."""
    tokens = spread(docs.select(content)).select(text.code_tokens(F.col(content)).alias("tokens"))
    # a term that no text can hold stands for all documents, so that one pass gives terms and totals
    each = tokens.select(F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("\0")), F.array_distinct("tokens"))).alias("term"))
    counted = checkpoint(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("tokens")))  # one row a term, asked for twice
    total = counted.filter(F.col("term") == "\0").select(F.col("df").alias("n"), "tokens")
    return counted.filter(F.col("term") != "\0").select("term", "df").crossJoin(F.broadcast(total))  # one row


def bm25(docs: DataFrame, key: str, content: str, query: list[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(key, score) of the documents with some query term; repeated query terms count again.

    For a corpus without a stored index: one pass for the corpus statistics, one for the query's own postings.
    """
    weights = _weights(term_stats(docs, content), query, epsilon)
    own = spread(docs.select(key, content)).select(key, text.code_tokens(F.col(content)).alias("tokens"))
    found = own.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).filter(F.col("term").isin(sorted(set(query))))
    counts = found.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return _scored(counts.join(F.broadcast(weights), "term"), key, k1, b)  # one row a query term


def _bucket(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def write_bm25(docs: DataFrame, key: str, content: str, path: str) -> None:
    """A stored index: postings by bucket of their term, and term statistics. Written whole; it replaces what was there."""
    rows = postings(docs, key, content).withColumn("bucket", _bucket("term"))
    rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    term_stats(docs, content).write.mode("overwrite").parquet(f"{path}/terms")


def bm25_stored(spark: SparkSession, path: str, key: str, query: list[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """As ``bm25``, from a stored index: only the buckets of the query's terms are opened."""
    wanted = sorted(set(query))
    buckets = [r.b for r in spark.createDataFrame([(t,) for t in wanted], "term string").select(_bucket("term").alias("b")).distinct().collect()]  # of the query
    own = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    weights = _weights(spark.read.parquet(f"{path}/terms"), query, epsilon)
    return _scored(own.join(F.broadcast(weights), "term"), key, k1, b)  # one row a query term


def bm25_search(docs: DataFrame, key: str, content: str, query: list[str], top_k: int, max_k: int = 15, keep=None) -> DataFrame:
    """Cut to ``max_k``, then filter, then cut to ``top_k``; ties by key. ``score`` is 0 as callers expect, ``bm25`` the value."""
    best = bm25(docs, key, content, query).orderBy(F.desc("score"), key).limit(max_k)
    best = best if keep is None else best.filter(keep)
    return best.orderBy(F.desc("score"), key).limit(top_k).select(key, F.lit(0.0).alias("score"), F.col("score").alias("bm25"))


def identifier_occurrences(chunks: DataFrame, identifier: str, context: str = "", top_k: int = 20) -> DataFrame:
    """Chunks that use an identifier as a whole word and do not declare it, by context, calls and position."""
    symbol = identifier.strip().removesuffix("()").rsplit(".", 1)[-1]
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", symbol):
        raise ValueError("identifier must be a single code identifier")
    own = set(re.findall("[a-z0-9]+", symbol.lower()))
    terms = sorted({t for t in re.findall("[a-z0-9]+", context.lower()) if len(t) >= 3} - own - set(text.CALL_STOP))
    flat = F.array_join(text.code_tokens(F.concat_ws(" ", "node_id", "file", "content")), " ")
    context_score = F.lit(0)
    for t in terms:
        context_score = context_score + F.regexp_count(flat, F.lit(re.escape(t)))
    calls = F.regexp_count("content", F.lit(rf"(?<![A-Za-z0-9_]){symbol}\s*\("))
    declared = F.substring_index(F.regexp_replace(F.coalesce("name", F.lit("")), r"\(\)$", ""), ".", -1) == symbol
    hits = chunks.filter(F.col("content").rlike(rf"(?<![A-Za-z0-9_]){symbol}(?![A-Za-z0-9_])") & ~declared)
    hits = hits.withColumn("calls", calls.cast("long")).withColumn("context_score", context_score.cast("long"))
    hits = hits.withColumn("score", F.when(F.col("calls") > 0, F.col("calls")).otherwise(1).cast("double"))
    return hits.orderBy(F.desc("context_score"), F.desc("calls"), "position").limit(top_k)


MAX_PATTERN, MAX_CONTENT = 4096, 8000


def regex_search(nodes: DataFrame, pattern: str, top_k: int, file_glob: str | None = None, node_type: str | None = None, case_sensitive: bool = False, plain: bool = False, order: str = "vid") -> DataFrame:
    """Nodes whose first 8000 characters match, in vertex order. Patterns over the budget raise."""
    if not pattern or len(pattern) > MAX_PATTERN:
        raise ValueError("pattern is empty or too long")
    head = F.substring("content", 1, MAX_CONTENT)
    if plain:
        hit = F.contains(head, F.lit(pattern)) if case_sensitive else F.contains(F.lower(head), F.lit(pattern.lower()))
    else:
        hit = head.rlike(pattern if case_sensitive else f"(?i){pattern}")
    hit = hit & paths.matches_glob(F.col("file"), file_glob) if file_glob else hit
    hit = hit & (F.col("type") == node_type) if node_type else hit
    return nodes.filter(hit).orderBy(order).limit(top_k)


def grep(files: DataFrame, pattern: str, mode: str = "content", glob: str | None = None, limit: int | None = None) -> DataFrame:
    """One row a matching line (content), file (files) or count (count). Line numbers from 1."""
    own = files.filter(paths.matches_glob(F.col("file"), glob)) if glob else files
    lines = own.filter(F.col("content").rlike(pattern)).select("file", F.posexplode(F.split("content", "\n", -1)).alias("n", "line")).filter(F.col("line").rlike(pattern))
    if mode == "content":
        out, order = lines.select("file", (F.col("n") + 1).cast("long").alias("line_no"), "line"), ["file", "line_no"]
    elif mode == "count":
        out, order = lines.groupBy("file").agg(F.count("*").alias("matches")), ["file"]
    else:
        out, order = lines.select("file").distinct(), ["file"]
    return out.orderBy(*order).limit(limit) if limit else out


def glob(files: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    out = files.filter(paths.matches_glob(F.col("file"), pattern) & paths.is_visible(F.col("file"))).select("file")
    return out.orderBy("file").limit(limit) if limit else out


def trigram_table(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """(trigram, key): an index to write once, by trigram."""
    # characters as an array: reaching into a string by position would scan it from the start each time
    own = spread(files.filter(F.length(content) >= 3).select(key, content)).select(key, F.split(F.lower(content), "").alias("__c"))
    at = lambda i: F.get(F.col("__c"), i)
    grams = F.transform(F.sequence(F.lit(0), F.size("__c") - 3), lambda i: F.concat(at(i), at(i + 1), at(i + 2)))
    return own.select(key, F.explode(F.array_distinct(grams)).alias("trigram"))


def write_trigrams(files: DataFrame, path: str, key: str = "file", content: str = "content") -> None:
    """The trigram index stored by bucket of the trigram. Written whole; it replaces what was there."""
    rows = trigram_table(files, key, content).withColumn("bucket", _bucket("trigram"))
    rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "trigram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored_trigrams(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(trigram, key) of a stored index for a needle: only the buckets of its trigrams are opened."""
    low = needle.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    buckets = [r.b for r in spark.createDataFrame([(g,) for g in grams], "trigram string").select(_bucket("trigram").alias("b")).distinct().collect()]  # of the needle
    return spark.read.parquet(path).filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(grams)).drop("bucket")


def trigram_search(files: DataFrame, needle: str, index: DataFrame | None = None) -> DataFrame:
    """Files that hold a string, one row each: lines from and to (from 1) and ``L<n>:`` fragments.

    With an index, files that lack a trigram of the needle are not opened.
    """
    low = needle.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if index is not None and grams:
        hits = index.filter(F.col("trigram").isin(grams)).groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("file")
        files = files.join(hits, "file", "left_semi")
    lines = files.filter(F.contains(F.lower("content"), F.lit(low))).select("file", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    lines = lines.filter(F.contains(F.lower("line"), F.lit(low))).withColumn("n", F.col("n") + 1)
    fragment = F.struct("n", F.concat(F.lit("L"), F.col("n").cast("string"), F.lit(": "), F.col("line")).alias("f"))
    return lines.groupBy("file").agg(
        F.min("n").cast("long").alias("first_line"), F.max("n").cast("long").alias("last_line"),
        F.array_join(F.transform(F.sort_array(F.collect_list(fragment)), lambda x: x["f"]), "\n").alias("fragments"),
    )


def near_duplicate_sentences(rows: DataFrame, section: str, key: str, content: str, least: int = 5, threshold: float = 0.7) -> DataFrame:
    """Pairs of a section whose term sets overlap by ``threshold`` of the smaller.

    Pairs are found by rare shared terms: each set is indexed under its least common terms, as many as
    it could miss and still pass, so sections are not crossed with themselves.
    """
    sets = rows.select(section, key, text.prose_terms(F.col(content)).alias("terms")).filter(F.size("terms") >= least)
    flat = sets.select(section, key, F.explode("terms").alias("term"), F.size("terms").alias("n"))
    df = flat.groupBy(section, "term").agg(F.count("*").alias("df")).filter("df > 1")
    shared = checkpoint(flat.join(df, [section, "term"], "left").withColumn("i", F.row_number().over(W.partitionBy(section, key).orderBy(F.coalesce("df", F.lit(1)), "term"))).filter("df is not null"))
    # of the smaller set the first n - need + 1 terms, rare first, must hold one that the larger has
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    a, b = shared.filter(F.col("i") <= F.col("n") - need + 1).alias("a"), shared.alias("b")
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    met = a.join(b, (F.col(f"a.{section}") == F.col(f"b.{section}")) & (F.col("a.term") == F.col("b.term")) & smaller)
    pairs = met.select(F.col(f"a.{section}").alias(section), F.least(f"a.{key}", f"b.{key}").alias("left"), F.greatest(f"a.{key}", f"b.{key}").alias("right")).distinct()
    x, y = (sets.select(section, F.col(key).alias(side), F.col("terms").alias(f"__{side}")) for side in ("left", "right"))
    both = pairs.join(x, [section, "left"]).join(y, [section, "right"])
    return both.withColumn("overlap", text.overlap_ratio(F.col("__left"), F.col("__right"))).filter(F.col("overlap") >= threshold).select(section, "left", "right", "overlap")


def duplicate_blocks(rows: DataFrame, content: str, key: str) -> DataFrame:
    """Texts equal once case and white space are levelled: how often, and where first."""
    norm = F.trim(F.regexp_replace(F.lower(F.col(content)), r"[\x20\t\n\r]+", " "))
    return rows.groupBy(F.md5(norm).alias("block")).agg(F.count("*").alias("copies"), F.min(key).alias("first_key")).filter("copies > 1")


def predicate_scores(rows: DataFrame, query: list[str], limit: int) -> DataFrame:
    """Identifiers of retrieved branches, scored by query terms: the best (score, -rank, branch) of each."""
    names = rows.select("branch", "rank", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)))).alias("identifier"))
    terms = text.subword_terms(F.col("identifier"))
    own = F.when(F.col("rank") == 1, 4).otherwise(3) + F.size(F.array_intersect(terms, F.array(*[F.lit(q) for q in query])))
    best = names.withColumn("score", own).groupBy("identifier").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), (-F.col("branch")).alias("b"))).alias("best"))
    return best.select("identifier", F.col("best.score").cast("long").alias("score"), (-F.col("best.r")).cast("long").alias("rank")).orderBy(F.desc("score"), "rank", "identifier").limit(limit)


# Verbs that stand for one another in questions about actions.
ACTION_ALIASES = {
    "persist": ["save", "serialize", "write"], "persisted": ["save", "serialize", "write"], "persistence": ["save", "serialize", "write"], "persists": ["save", "serialize", "write"],
    "save": ["persist", "serialize", "write"], "saved": ["persist", "serialize", "write"], "serialize": ["persist", "save", "write"], "serialized": ["persist", "save", "write"],
    "write": ["persist", "save", "serialize"], "writes": ["persist", "save", "serialize"], "written": ["persist", "save", "serialize"],
}


def action_terms(query: str) -> list[str]:
    """Verbs to add to a query: aliases of its terms, in order, that it does not hold itself."""
    terms = list(dict.fromkeys(re.findall("[a-z0-9_]+", query.lower())))
    return list(dict.fromkeys(a for t in terms for a in ACTION_ALIASES.get(t, []) if a not in terms))


def action_identifiers(rows: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """(identifier, branch, rank): names in retrieved branches that are one of the query's action verbs, by first appearance."""
    terms = set(re.findall("[a-z0-9_]+", query.lower()))
    wanted = sorted({*action_terms(query), *(terms & set(ACTION_ALIASES))})
    name = F.regexp_replace(F.regexp_extract(F.coalesce(F.col("name"), "node_id"), r"([^:]*)$", 1), r"\([^)]*\)$", "")
    own = rows.withColumn("identifier", F.regexp_extract(name, r"([^.]*)$", 1)).filter(F.lower("identifier").isin(wanted))
    first = own.groupBy("identifier").agg(F.min(F.struct("branch", "rank")).alias("at"))
    return first.orderBy("at", "identifier").limit(limit).select("identifier", "at.branch", "at.rank")


def graph_documents(vertices: DataFrame) -> DataFrame:
    """(id, content): one document a vertex for lexical retrieval, its unified name if it has one, else its name."""
    name = F.coalesce("unified_name", "name") if "unified_name" in vertices.columns else F.col("name")
    return vertices.select(F.col("vid").alias("id"), name.alias("content"))
