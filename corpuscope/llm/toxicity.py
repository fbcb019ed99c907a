"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import bounded_sample, held_out, slices, training_fold
from corpuscope.llm.words import WordBatch

#: n-grams of a marked word that share its embedding, table sizes, widths of the filters.
NGRAMS = (3, 5, 6)
BITS = 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
THRESHOLD = 0.7
SLICE_CHARS = 1_500_000

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class ConvNet:
    """Embedding, parallel filters of several widths, max pooling over the text, one logistic output."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.ngram = (r.standard_normal((1 << BITS, DIM)) * 0.3).astype(np.float32)
        self.word = (r.standard_normal((1 << BITS, DIM)) * 0.3).astype(np.float32)
        self.ngram[0] = self.word[0] = 0
        self.filters = {w: (r.standard_normal((w, DIM, FILTERS)) * (0.6 / w)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (r.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.base = np.float32(-1.0)
        # languages told from the text alone, and the logit that means THRESHOLD in each
        self.tongues = np.zeros((1 << BITS, 1), np.float32)
        self.cuts = np.zeros(1)
        self.constant: float | None = None
        self._rows = None

    def tables(self, batch: WordBatch):
        """Embedding of each distinct word, and how well it fits each language."""
        both = batch.sums(self.rows, NGRAMS, BITS)
        table = (both[:, :DIM] + self.word[batch.word_feature(BITS)]) / (1 + both[:, DIM : DIM + 1])
        return np.ascontiguousarray(table, np.float32), both[:, DIM + 1 :]

    @property
    def rows(self):
        """n-gram rows side by side: embedding, 1 (so that sums count them), languages."""
        if self._rows is None:
            one = np.ones((1 << BITS, 1), np.float32)
            one[0] = 0
            self._rows = np.hstack([self.ngram, one, self.tongues])
        return self._rows

    def pooled(self, table, ids, first):
        """Largest response of every filter in each text, and the word where it is (-1: no word)."""
        n = np.diff(first)
        has = np.flatnonzero(n)
        best = np.zeros((len(n), FILTERS * len(WIDTHS)), np.float32)
        where = np.full(best.shape, -1, np.int64)
        if not len(has):
            return best, where
        text_end = np.repeat(first[1:], n)
        at = np.arange(len(ids))
        for k, w in enumerate(WIDTHS):
            z = None
            for j in range(w):
                part = (table @ self.filters[w][j])[ids[np.minimum(at + j, len(ids) - 1)]]
                part[at + j >= text_end] = 0  # beyond the text there is nothing
                z = part if z is None else z + part
            top = np.maximum.reduceat(z, first[:-1][has], axis=0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best[has, cols] = top
            if self.training:
                spot = np.where(z == np.repeat(top, n[has], axis=0), at[:, None], np.iinfo(np.int64).max)
                where[has, cols] = np.minimum.reduceat(spot, first[:-1][has], axis=0)
        return best, where

    training = False

    def logits(self, batch: WordBatch, table):
        best, _ = self.pooled(table, batch.ids, batch.first)
        bias = np.concatenate([self.bias[w] for w in WIDTHS])
        empty = (np.diff(batch.first) == 0)[:, None]
        return np.where(empty, 0, np.maximum(best + bias, 0)) @ self.out + self.base

    def tongue(self, batch: WordBatch, per_word):
        """The group of each text: the language whose n-grams fit best."""
        total = np.zeros((len(batch.first) - 1, per_word.shape[1]))
        has = np.flatnonzero(np.diff(batch.first))
        if len(has):
            total[has] = np.add.reduceat(per_word[batch.ids], batch.first[:-1][has], axis=0)
        return total.argmax(1)

    def scores(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = []
        for a, b in slices(texts, SLICE_CHARS):
            batch = WordBatch(texts[a:b])
            table, per_word = self.tables(batch)
            logit = self.logits(batch, table)
            out.append(_sigmoid(logit - self.cuts[self.tongue(batch, per_word)] + np.log(THRESHOLD / (1 - THRESHOLD))))
        return np.concatenate(out) if out else np.zeros(0)


def _minibatches(n: int, size: int, r):
    order = r.permutation(n)
    return [order[i : i + size] for i in range(0, n, size)]


def train(texts: list, toxic: np.ndarray, lang: list, share: float | None = None, epochs: int = 8, least_steps: int = 250, rate: float = 0.08, seed: int = 11) -> ConvNet:
    """Fit on three quarters of the rows by Adagrad; the rest sets the threshold of each language.

    ``share`` is the share of toxic rows among all that may be learned from, where the sample's differs.
    """
    net = ConvNet(seed)
    toxic = np.asarray(toxic, np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        net.constant = float(toxic.mean()) * 0.98 + 0.01 if len(toxic) else 0.5
        return net
    r = np.random.default_rng(seed)
    batch = WordBatch(texts)
    features = batch.features(NGRAMS, BITS)
    # n-gram ids of each distinct word, in rows
    size = np.diff(np.append(batch.begin, len(batch.spelled)))
    grams = np.stack(features, 1)
    whole = batch.word_feature(BITS)
    held = np.zeros(len(toxic), bool)
    for y in (0, 1):
        own = r.permutation(np.flatnonzero(toxic == y))
        held[own[: len(own) // 4]] = True
    rows = np.flatnonzero(~held)
    memory: dict = {}

    def step(name, array, grad, at=None):
        g2 = memory.setdefault(name, np.full(array.shape, 1e-6, np.float32))
        if at is None:
            g2 += grad * grad
            array -= rate * grad / np.sqrt(g2)
        else:
            g2[at] += grad * grad
            array[at] -= rate * grad / np.sqrt(g2[at])

    net.training = True
    epochs = max(epochs, -(-least_steps * 64 // max(len(rows), 1)))  # few rows are seen more often
    for _ in range(epochs):
        for part in _minibatches(len(rows), 64, r):
            docs = rows[part]
            n = np.diff(batch.first)[docs]
            first = np.concatenate(([0], np.cumsum(n)))
            spot = np.repeat(batch.first[docs], n) + np.arange(first[-1]) - np.repeat(first[:-1], n)
            used, ids = np.unique(batch.ids[spot], return_inverse=True)
            ids = ids.ravel()
            # embeddings of the words in this minibatch
            long = size[used]
            gram_at = np.repeat(batch.begin[used], long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            own = grams[gram_at]
            begin = np.cumsum(long) - long
            count = 1 + (np.add.reduceat((own > 0).sum(1), begin) if len(used) else np.zeros(0))
            table = net.word[whole[used]].copy()
            for k in range(own.shape[1] if len(used) else 0):
                table += np.add.reduceat(net.ngram[own[:, k]], begin, axis=0)
            table /= count[:, None].astype(np.float32)
            best, where = net.pooled(table, ids, first)
            bias = np.concatenate([net.bias[w] for w in WIDTHS])
            live = (best + bias > 0) & (where >= 0)
            pooled = np.where(live, best + bias, 0)
            p = _sigmoid(pooled @ net.out + net.base)
            d = ((p - toxic[docs]) / len(docs)).astype(np.float32)
            back = np.where(live, d[:, None] * net.out, 0)
            d_table = np.zeros_like(table)
            d_filters = {}
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g, at = back[:, cols], where[:, cols]
                d_filters[w] = np.zeros_like(net.filters[w])
                for j in range(w):
                    own_g = np.where(at + j < first[1:, None], g, 0)
                    word = ids[np.clip(at + j, 0, len(ids) - 1)] if len(ids) else at * 0
                    d_filters[w][j] = np.einsum("nf,nfd->df", own_g, table[word])
                    doc, f = np.nonzero(own_g)
                    np.add.at(d_table, word[doc, f], own_g[doc, f, None] * net.filters[w][j].T[f])
            touched = np.flatnonzero(np.abs(d_table).sum(1))
            for w in WIDTHS:
                step(("f", w), net.filters[w], d_filters[w])
                k = WIDTHS.index(w)
                step(("b", w), net.bias[w], back[:, k * FILTERS : (k + 1) * FILTERS].sum(0))
            step("out", net.out, pooled.T @ d)
            base = np.array([net.base], np.float32)
            step("base", base, np.array([d.sum()], np.float32))
            net.base = base[0]
            if len(touched):
                each = d_table[touched] / count[touched, None].astype(np.float32)
                for name, array, at, g in (
                    ("word", net.word, whole[used[touched]], each),
                    ("ngram", net.ngram, *_gram_rows(own, begin, long, touched, each)),
                ):
                    rows_at, inverse = np.unique(at, return_inverse=True)
                    total = np.zeros((len(rows_at), DIM), np.float32)
                    np.add.at(total, inverse.ravel(), g)
                    keep = rows_at > 0
                    step(name, array, total[keep], rows_at[keep])
    net.training = False
    own = toxic.mean()
    share = own if share is None else share
    clean_weight = (1 - share) / share * own / (1 - own) if 0 < share < 1 else 1.0
    _calibrate(net, batch, features, toxic, held, lang, clean_weight)
    return net


def _in_parts(net: ConvNet, batch: WordBatch, words: int = 1 << 18):
    """The language group and the logit of each text, some texts at a time, so that little is held beside the batch."""
    table, per_word = net.tables(batch)
    group, logit, a = [], [], 0
    while a < len(batch.first) - 1:
        b = max(a + 1, int(np.searchsorted(batch.first, batch.first[a] + words, side="right")) - 1)
        part = copy.copy(batch)
        part.first, part.ids = batch.first[a : b + 1] - batch.first[a], batch.ids[batch.first[a] : batch.first[b]]
        group.append(net.tongue(part, per_word))
        logit.append(net.logits(part, table))
        a = b
    return np.concatenate(group), np.concatenate(logit)


def _gram_rows(own, begin, long, touched, share):
    n = long[touched]
    at = np.repeat(begin[touched], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return own[at].ravel(), np.repeat(np.repeat(share, n, axis=0), own.shape[1], axis=0)


def _calibrate(net: ConvNet, batch: WordBatch, features, toxic, held, lang, clean_weight):
    names = sorted({x for x in lang if x})
    seen = np.zeros((len(names) or 1, 1 << BITS))
    owner = np.array([names.index(x) if x else -1 for x in lang])
    text = np.repeat(np.arange(len(lang)), np.diff(batch.first))
    long = np.diff(np.append(batch.begin, len(batch.spelled)))
    for k in range(len(names)):
        times = np.bincount(batch.ids[owner[text] == k], minlength=len(batch.hashes))
        for f in features:
            seen[k] += np.bincount(f, np.repeat(times, long), 1 << BITS)
    seen[:, 0] = 0
    net.tongues = (np.log(seen + 0.5) - np.log(seen.sum(1, keepdims=True) + 0.5 * seen.shape[1])).T.astype(np.float32)
    net.tongues[0] = 0
    group, logit = _in_parts(net, batch)

    def cut(rows, default):
        """The logit with the best F1, midway between its neighbours."""
        x, y = logit[rows], toxic[rows]
        if y.sum() < 5 or (1 - y).sum() < 5:
            return default
        order = np.argsort(-x, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (hit + np.cumsum(1 - y[order]) * clean_weight + y.sum())
        f1[:-1][x[order][:-1] == x[order][1:]] = -1
        i = int(f1.argmax())
        return float(x[order][i] + (x[order][i + 1] if i + 1 < len(x) else x[order][i] - 1)) / 2

    whole = cut(np.flatnonzero(held), 0.0)
    net.cuts = np.array([cut(np.flatnonzero(held & (group == k)), whole) for k in range(net.tongues.shape[1])])


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = 1500, max_chars: int = 200_000, sample_chars: int = 6_000_000) -> ConvNet:
    """Train on a bounded sample: at most ``sample_per_class`` labelled rows a class from the learning folds, of ``sample_chars`` at most together.

    The sample is the smallest by hash of the id; texts over ``max_chars`` are not learned from
    (they are scored whole). Documents with conflicting labels count with the larger one.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.filter(training_fold(F.col("doc_id")))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").filter(training_fold(F.col("doc_id")) & (F.length("text") <= max_chars))
    # rows are picked by id before their texts are fetched: ordering moves ids and lengths alone
    share = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    known = rows.select("doc_id", F.length("text").alias("chars")).groupBy("doc_id").agg(F.max("chars").alias("chars")).join(own, "doc_id")
    found = []
    for y in (0, 1):
        picked = bounded_sample(known.filter(F.col("toxic") == y), sample_per_class, sample_chars)
        found += [(r.doc_id, r.text, r.lang, y) for r in rows.join(F.broadcast(picked), "doc_id").limit(2 * sample_per_class).collect()]
    found.sort(key=lambda r: r[:2])
    return train([r[1] for r in found], np.array([r[3] for r in found]), [r[2] for r in found], share)


def score(docs: DataFrame, net: ConvNet, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column: score (0 to 1) and predicted (1 from ``THRESHOLD`` on).

    Only the text is looked at, and the whole of it. Null or empty texts get the score of no words;
    other columns stay; equal texts have equal scores; an empty table stays empty. With labels of one
    class alone every score is that class's smoothed share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input

    def run(batches):
        net = shared.value
        for texts in batches:
            s = net.scores(texts.tolist())
            yield pd.DataFrame({"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    return docs.withColumn(into, F.pandas_udf(run, RESULT, F.PandasUDFType.SCALAR_ITER)(F.col("text").cast("string")))


def report(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    net = fit(docs, labels, **params)
    return score(docs.select("doc_id", "text"), net, "toxicity").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted"
    )


def reject(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` without those predicted toxic; columns unchanged."""
    name = "__toxicity"
    return score(docs, fit(docs, labels, **params), name).filter(f"{name}.predicted = 0").drop(name)
