"""Line dedup: a fixed-depth log-template tree; lines of templates that recur across documents are dropped.

The tree sends a line by its token count and its leading tokens to a leaf; tokens with a digit count as
variable. Within a leaf a token stays in the template where it recurs at its place in enough documents;
any other place is a variable field. A template recurs when the documents that hold it are many and
unlike one another, so that copies of one document do not make its lines boilerplate.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import checkpoint, keep_known

#: Leading tokens that choose a leaf; lines with fewer tokens than MIN_TOKENS are never dropped.
DEPTH = 3
MIN_TOKENS = 3
#: Unlike documents that make a template recurrent; share of its tokens without a digit that must be constant,
#: and their least number.
MIN_DOCS = 10
MIN_CONSTANT = 0.6
LEAST_CONSTANT = 2
#: Families of documents per distinct text: below this, a template's documents are copies of a few.
MIN_UNLIKE = 0.7
#: Leaves are sieved in the second pass by a bitmap of fixed size.
SIEVE_BITS = 22

_DIGIT = re.compile(r"\d")


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def leaf_of(tokens: list[str], depth: int) -> int:
    return _hash("\x1f".join([str(len(tokens)), *("\x00" if _DIGIT.search(t) else t for t in tokens[:depth])]))


def ends_of(tokens: list[str], depth: int, leaf: int) -> tuple[int, int]:
    """How a line begins and ends; tokens with a digit count as themselves where there are no others."""
    plain = lambda part: all(_DIGIT.search(t) for t in part)
    first, last = tokens[:depth], tokens[-2 * depth :]
    opening = _hash("\x1d" + "\x1f".join([str(len(tokens)), *tokens[: 2 * depth]])) if plain(first) else leaf
    return opening, _hash("\x1e" + "\x1f".join(last if plain(last) else ["\x00" if _DIGIT.search(t) else t for t in last]))


def parse(text, depth: int):
    """[(line number, leaf, (opening, closing), tokens)] of a text's lines that have tokens."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if tokens := line.split():
            leaf = leaf_of(tokens, depth)
            out.append((i, leaf, ends_of(tokens, depth, leaf), tokens))
    return out


def families_of(lines, body: int, depth: int, known):
    """The two families of each line's document, as told from lines that do not recur themselves.

    These begin and end unlike the lines of many other texts (``known``); one edit of a near copy's line
    leaves one of both as it was. Without such lines the document is told by how its other lines begin,
    which near copies share, and without other lines by its text. There are two families because one
    may be a common line that ``known`` has not.
    """
    own = sorted({ends[0] for _, _, ends, _ in lines if not any(map(known, ends))})[:2]
    if own:
        return [[own[0], own[-1]]] * len(lines)
    openings = [_hash(f"{len(tokens)} " + " ".join(tokens[:depth])) for _, _, _, tokens in lines]
    least = sorted(set(openings))[:3]
    if len(least) == 1:
        return [[body, body]] * len(lines)
    return [([x for x in least if x != opening][:2] + [0])[:2] for opening in openings]


def _leaves(depth):
    def run(batches):
        for pdf in batches:
            seen = set()
            for text in pdf["text"]:
                if isinstance(text, str):
                    body = _hash(text)
                    for _, leaf, ends, _ in parse(text, depth):
                        seen.update((x, body) for x in (leaf, *ends))
            if seen:
                rows = np.array(list(seen), np.int64)
                yield pd.DataFrame({"leaf": rows[:, 0], "body": rows[:, 1]})

    return run


def _tokens(depth, min_tokens, sieve):
    def run(batches):
        bits = sieve.value
        known = lambda x: bits[x & (1 << SIEVE_BITS) - 1]
        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"].tolist(), pdf["text"].tolist()):
                if not isinstance(text, str):
                    continue
                lines = parse(text, depth)
                if not any(len(tokens) >= min_tokens and known(leaf) for _, leaf, _, tokens in lines):
                    continue
                own = _hash(text)
                for (i, leaf, _, tokens), families in zip(lines, families_of(lines, own, depth, known)):
                    if len(tokens) >= min_tokens and known(leaf):
                        out.append((key, i, leaf, families, own, [0 if _DIGIT.search(t) else _hash(t) for t in tokens]))
            if out:
                yield pd.DataFrame(out, columns=["key", "line", "leaf", "families", "body", "tokens"])

    return run


def _unlike(rows: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``: its families (the larger number of the two slots), and its distinct texts."""
    own = rows.select(by, "body", F.posexplode("families").alias("slot", "family"))
    each = own.distinct().groupBy(by, "slot", "family").agg(F.count("*").alias("n"))
    slots = each.groupBy(by, "slot").agg(F.count("*").alias("families"), F.sum("n").alias("bodies"))
    return slots.groupBy(by).agg(F.max("families").alias("families"), F.max("bodies").alias("bodies"))


def recurring_lines(docs: DataFrame, key: str, min_docs: int = MIN_DOCS, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """(key, line): the lines of ``docs`` (columns key and text) whose template recurs."""
    leaves = docs.select("text").mapInPandas(_leaves(depth), "leaf long, body long").distinct()
    common = checkpoint(leaves.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"))
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    slots = common.select(F.col("leaf").bitwiseAND((1 << SIEVE_BITS) - 1).cast("int").alias("slot")).distinct()
    for row in slots.toLocalIterator():  # at most 2 ** SIEVE_BITS small numbers
        sieve[row.slot] = True
    sieve = docs.sparkSession.sparkContext.broadcast(sieve)
    lines = docs.select("key", "text").mapInPandas(_tokens(depth, min_tokens, sieve), "key long, line int, leaf long, families array<long>, body long, tokens array<long>")
    lines = checkpoint(keep_known(lines, common, ["leaf"], "key"))
    # constant tokens: those that recur at their place in the leaf, exact copies counted once
    placed = lines.select("key", "line", "leaf", "body", F.posexplode("tokens").alias("place", "token")).filter("token <> 0")
    constant = (
        placed.select("leaf", "place", "token", "body").distinct().groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).drop("n")
    )
    kept = (
        keep_known(placed.select("key", "line", "leaf", "place", "token"), constant, ["leaf", "place", "token"], "key")
        .groupBy("key", "line", "leaf")
        .agg(F.count("*").alias("kept"), F.sum(F.xxhash64("place", "token") % (1 << 40)).alias("mark"))
    )
    parsed = lines.select("key", "line", "leaf", "families", "body", F.size(F.filter("tokens", lambda x: x != 0)).alias("n")).join(kept, ["key", "line", "leaf"])
    parsed = parsed.filter((F.col("kept") >= F.lit(min_constant) * F.col("n")) & (F.col("kept") >= LEAST_CONSTANT)).select("key", "line", "families", "body", F.xxhash64("leaf", "mark", "kept").alias("template"))
    parsed = checkpoint(parsed)
    recurrent = _unlike(parsed, "template").filter((F.col("families") >= min_docs) & (F.col("families") >= MIN_UNLIKE * F.col("bodies"))).select("template")
    return keep_known(parsed, recurrent, ["template"], "key").select(F.col("key").alias(key), "line").distinct()


def drop_recurring(docs: DataFrame, into: str = "dropped_lines", **params) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and an array of their numbers (from 0) in ``into``.

    Lines are parted by newlines. Empty lines and lines of fewer than ``min_tokens`` tokens stay; null
    text stays null; a text of recurring lines alone becomes empty, its row stays. Rows with equal id
    and text get equal results. Other columns are kept as they are. Two passes over the texts; rows
    move once more to take their lists of lines.
    """
    key = "__row_key"
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")))
    found = recurring_lines(keyed.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), key, **params)
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list("line")).alias(into))
    out = keyed.drop(into).join(lists, key, "left").withColumn(into, F.coalesce(into, F.array().cast("array<int>")))
    lines = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(into), i))
    text = F.when(F.size(into) > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))
    return out.withColumn("text", text).drop(key)


def report(docs: DataFrame, **params) -> DataFrame:
    own = docs.select("doc_id", "text").withColumn("n_lines", F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("long"))
    out = drop_recurring(own, **params)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped"), "text",
    )
