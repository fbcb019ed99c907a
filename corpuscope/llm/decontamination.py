"""Benchmark decontamination: test suffixes are binary-searched in suffix arrays over shards of the training texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import byte_table, checkpoint, joined_words, mix64, slices

#: Bytes between words once A-Z are lower case: every ASCII character but digits and letters.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]

#: Words of a suffix that the arrays are sorted by; longer matches are followed word by word.
DEPTH = 16

#: Characters of test text in one broadcast block; a larger test set is searched block after block.
BLOCK_CHARS = 8_000_000

#: Characters of training text in one shard.
SHARD_CHARS = 2_000_000

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_start", T.LongType()),
        T.StructField("longest_item", T.StringType()),
    ]
)


def _keys(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Sortable byte strings of the ``depth`` word ids from each position."""
    k = words[at[:, None] + np.arange(depth)].astype(">u4")
    return np.ascontiguousarray(k).view(f"S{4 * depth}").ravel()


def _seed(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[at + j].astype(np.uint64)
    return mix64(h) & np.uint64((1 << 22) - 1)


def suffix_ranks(words: np.ndarray) -> np.ndarray:
    """The place of each suffix of a sequence in their order, by doubling; suffixes alike to the end of doubling share one."""
    rank, n, k = np.unique(words, return_inverse=True)[1].ravel().astype(np.int64), 0, 1
    while k < 2 * len(words):
        later = np.zeros(len(rank), np.int64)
        later[:-k or None] = rank[k:] + 1 if k < len(rank) else 0
        known, rank = np.unique(rank * (len(rank) + 1) + later, return_inverse=True)
        rank = rank.ravel().astype(np.int64)
        if len(known) == n or len(known) == len(rank):
            break
        n, k = len(known), 2 * k
    return rank


class TestSuffixes:
    """The suffixes of one block of test items, those with equal windows together."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int, table: np.ndarray):
        by_text: dict[str, list[str]] = {}
        for i, t in zip(ids, texts):
            by_text.setdefault(t, []).append(i)
        self.owners = [sorted(set(x)) for x in by_text.values()]  # items with one text share its suffixes
        h, first = joined_words(list(by_text), table)
        self.vocabulary, ranks = np.unique(h, return_inverse=True)
        n_words = np.diff(first)
        self.words = np.zeros(len(h) + (len(n_words) + 1) * DEPTH, np.int64)
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        place = np.arange(len(h)) + text_of * DEPTH
        self.words[place] = ranks.ravel() + 1
        need = np.minimum(window, n_words)
        inside = np.arange(len(h)) - np.repeat(first[:-1], n_words)
        whole = inside <= np.repeat(n_words - need, n_words)  # a window begins here
        at, text_of = place[whole], text_of[whole]
        need = need[text_of]
        keys = self.words[at[:, None] + np.arange(window)]
        keys[np.arange(window) >= need[:, None]] = 0
        packed = np.ascontiguousarray(np.column_stack([need, keys]).astype(">u4")).view(f"S{4 * (window + 1)}").ravel()
        # suffixes with one window come in the order of what follows
        order = np.lexsort((suffix_ranks(self.words)[at], packed)) if len(at) else np.zeros(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = packed[order][1:] != packed[order][:-1]
        begin = np.flatnonzero(new)
        self.suffix_at, self.suffix_text = at[order], text_of[order]
        self.begin = np.append(begin, len(order))
        self.need = need[order][begin]
        low = np.zeros((len(begin), DEPTH), np.int64)
        low[:, :window] = keys[order][begin]
        high = np.where(np.arange(DEPTH) >= self.need[:, None], 0xFFFFFFFF, low)
        self.low, self.high = (np.ascontiguousarray(x.astype(">u4")).view(f"S{4 * DEPTH}").ravel() for x in (low, high))
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.seeds = {}
        for n in (1, 2, 3):
            own = self.suffix_at[self.begin[:-1]][self.need == n if n < 3 else self.need >= 3]
            if len(own):
                self.seeds[n] = np.zeros(1 << 22, bool)
                self.seeds[n][_seed(self.words, own, n).astype(np.int64)] = True

    def search(self, h: np.ndarray, first: np.ndarray):
        """Matches in a shard: its text, word position, words hit, texts of the items and the longest match of each."""
        n_words = np.diff(first)
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        words = np.zeros(len(h) + len(n_words) + DEPTH + 1, np.int64)
        near = np.flatnonzero(self.known[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        rank = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
        right = self.vocabulary[rank] == h[near]
        near = near[right]
        words[near + text_of[near]] = rank[right] + 1
        # the suffixes that no test suffix can match are left out of the array
        at = np.flatnonzero(words)
        keep = np.zeros(len(at), bool)
        for n, seeds in self.seeds.items():
            keep |= seeds[_seed(words, at, n).astype(np.int64)]
        at = at[keep]
        keys = _keys(words, at, DEPTH)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]  # the shard's suffix array
        lo, hi = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high, side="right")
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        which = np.repeat(found, count)
        p = at[np.repeat(lo[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        longest, longest_text = self._longest(words, p, which)
        ends = first[1:] + np.arange(1, len(first))  # of the texts, each one followed by a gap
        doc = np.searchsorted(ends, p, side="right")
        return doc, p - first[doc] - doc, which, longest, longest_text

    def _longest(self, words, p, which):
        """The longest match of each place with the suffixes of its window: binary search among them, in their order.

        The longest lies next to where the place's own suffix would stand.
        """
        longest, best = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        lo, hi = self.begin[which].copy(), self.begin[which + 1].copy()
        on = np.arange(len(p))
        while len(on):
            middle = (lo[on] + hi[on]) // 2
            q = self.suffix_at[middle]
            n = self._follow(words, p[on], q, self.need[which[on]])
            better = n > longest[on]
            longest[on[better]], best[on[better]] = n[better], middle[better]
            a, b = p[on] + n, q + n
            beyond = np.where(a < len(words), words[np.minimum(a, len(words) - 1)], 0) > np.where(b < len(self.words), self.words[np.minimum(b, len(self.words) - 1)], 0)
            lo[on[beyond]], hi[on[~beyond]] = middle[beyond] + 1, middle[~beyond]
            on = on[lo[on] < hi[on]]
        return longest, self.suffix_text[best]

    def _follow(self, words, p, q, n):
        n = n.copy()
        on = np.arange(len(p))
        while len(on):
            a, b = p[on] + n[on], q[on] + n[on]
            inside = (a < len(words)) & (b < len(self.words))
            on, a, b = on[inside], a[inside], b[inside]
            same = (words[a] == self.words[b]) & (words[a] > 0)
            on = on[same]
            n[on] += 1
        return n

    def items_of(self, which: np.ndarray) -> set[str]:
        texts = {t for w in set(which.tolist()) for t in self.suffix_text[self.begin[w] : self.begin[w + 1]].tolist()}
        return {i for t in texts for i in self.owners[t]}


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _search_texts(texts: list, blocks, table: np.ndarray) -> list[tuple]:
    h, first = joined_words(texts, table)
    out = [[int(n), [], set(), 0, None, None] for n in np.diff(first)]
    for block in blocks:
        doc, at, which, longest, text = block.search(h, first)
        order = np.argsort(doc, kind="stable")
        cuts = np.flatnonzero(np.diff(doc[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            row = out[doc[own[0]]]
            old = row[1]
            row[1] = _merged(np.append(at[own], old[::2]), np.append(at[own] + block.need[which[own]], old[1::2]))
            row[2] |= block.items_of(which[own])
            best = own[np.lexsort((at[own], -longest[own]))[0]]
            if longest[best] > row[3]:
                row[3:] = int(longest[best]), int(at[best]), block.owners[text[best]][0]
    return [(n, spans, sorted(items), most, start, item) for n, spans, items, most, start, item in out]


def _matches(blocks, table):
    def run(batches):
        for texts in batches:
            texts, rows = texts.tolist(), []
            for a, b in slices(texts, SHARD_CHARS):
                rows += _search_texts(texts[a:b], [x.value for x in blocks], table)
            yield pd.DataFrame(rows, columns=RESULT.names)

    return run


KEYED = "key long, hit_spans array<long>, items array<string>, longest long, longest_start long, longest_item string"


def _keyed_matches(blocks, table):
    """As rows by the hash of their text, of texts with a match alone."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices(texts, SHARD_CHARS):
                rows = [(k, *r[1:]) for k, r in zip(pdf["key"].tolist()[a:b], _search_texts(texts[a:b], [x.value for x in blocks], table)) if r[1]]
                if rows:
                    yield pd.DataFrame(rows, columns=["key", *RESULT.names[1:]])

    return run


def _merge_spans(spans: pd.Series) -> pd.Series:
    return pd.Series([_merged(np.asarray(x)[::2], np.asarray(x)[1::2]) for x in spans], dtype=object)


def _word_counts(table):
    def run(batches):
        for texts in batches:
            texts, out = texts.tolist(), []
            for a, b in slices(texts, SHARD_CHARS):
                out.append(np.diff(joined_words(texts[a:b], table)[1]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    return run


def blocks_of(items: DataFrame, window: int, table: np.ndarray):
    """Test items in blocks of bounded size, one at a time. Items without an id or a word take no part."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).dropna()
    rows = rows.filter(F.col("t").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    for row in rows.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
        if size >= BLOCK_CHARS:
            yield TestSuffixes(ids, texts, window, table)
            ids, texts, size = [], [], 0
    if ids:
        yield TestSuffixes(ids, texts, window, table)


def search(docs: DataFrame, items: DataFrame, window: int = 10, into: str = "match") -> DataFrame:
    """``docs`` with a struct column of its verbatim matches with the items, longest and all.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. ``hit_spans``
    are the merged word ranges (start, end, start, ...) inside any occurrence of a window, ``items``
    those with such a window, ``longest`` the words of the longest verbatim match and where it begins.

    Each batch of texts becomes shards with a suffix array of their own over those suffixes that begin
    as some test suffix does; every test suffix is binary-searched in every shard. Test items of up to
    ``BLOCK_CHARS`` are broadcast, and nothing is shuffled. Of more, block follows block: no more than one
    is held at a time by the driver or a worker, and only matches, by the hash of their text, are joined.

    Null or empty texts have no words; equal items and rows are reported once and for each row; all
    columns of ``docs`` stay (``into`` replaces a column of its name); empty tables give no matches.
    """
    table = byte_table(SEPARATORS)
    context = docs.sparkSession.sparkContext
    rest = blocks_of(items, window, table)
    block, second = next(rest, None), next(rest, None)
    if second is None:
        shared = [context.broadcast(x) for x in [block] if x is not None]  # one block at most
        found = F.pandas_udf(_matches(shared, table), RESULT, F.PandasUDFType.SCALAR_ITER)
        return docs.withColumn(into, found(F.col("text").cast("string")))
    # block after block: what each finds is written down before the next is held
    key, parts = F.xxhash64(F.col("text").cast("string")), []
    texts = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    while block is not None:
        shared = context.broadcast(block)
        parts.append(checkpoint(texts.mapInPandas(_keyed_matches([shared], table), KEYED).distinct()))
        shared.destroy()
        block, second = second, next(rest, None)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("key").agg(
        F.flatten(F.collect_list("hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.min_by(F.struct("longest", "longest_start", "longest_item"), F.struct(-F.col("longest"), "longest_start", "longest_item")).alias("m"),
    )
    merged = F.pandas_udf(_merge_spans, "array<bigint>")
    found = found.select(F.col("key").alias("__key"), merged("spans").alias("spans"), "items", "m")
    count = F.pandas_udf(_word_counts(table), "bigint", F.PandasUDFType.SCALAR_ITER)
    out = docs.withColumn("__key", key).withColumn("__words", count(F.col("text").cast("string"))).join(found, "__key", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    match = F.struct(
        F.col("__words").alias("n_words"), none(F.col("spans"), "bigint").alias("hit_spans"), none(F.col("items"), "string").alias("items"), F.coalesce("m.longest", F.lit(0).cast("long")).alias("longest"),
        F.col("m.longest_start").alias("longest_start"), F.col("m.longest_item").alias("longest_item"),
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()], match.alias(into))


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row a document: its words, words hit and contaminating items."""
    m = search(docs.select("doc_id", "text"), items, window, "match")
    # asked for once, so that the search runs once
    n_hit = F.expr("aggregate(sequence(0, greatest(size(match.hit_spans) div 2 - 1, 0)), 0L, (s, i) -> s + coalesce(get(match.hit_spans, 2 * i + 1) - get(match.hit_spans, 2 * i), 0L))")
    return m.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("match.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ","), 256).alias("items_sha256"),
        (F.size("match.hit_spans") > 0).alias("contaminated"),
    )


def remove_affected(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; columns unchanged."""
    name = "__benchmark_match"
    return search(docs, items, window, name).filter(F.size(f"{name}.hit_spans") == 0).drop(name)
