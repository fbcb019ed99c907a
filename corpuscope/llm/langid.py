"""Language ID: a linear-chain conditional random field labels the words of (code-switched) text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import bounded_sample, held_out, slices, training_fold
from corpuscope.llm.words import WordBatch

#: n-grams of a marked word (those with a mark are its affixes), table sizes, words of a segment.
NGRAMS = (2, 3, 4)
BITS = 16
LEXICON_BITS = 17
SEGMENT = 64
SLICE_CHARS = 1_500_000
UNKNOWN = "und"

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
#: Characters that may be letters; numerals such as fractions and superscripts are among them.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """True if any character is a letter (Unicode category L)."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class ChainCRF:
    """Emission weights of affixes, n-grams and lexicon entries, transitions between the labels, and forward-backward."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.ngram = np.zeros((1 << BITS, k), np.float32)
        self.lexicon = np.zeros((1 << LEXICON_BITS, k), np.float32)
        self.prior = np.zeros(k)
        self.move = np.zeros((k, k))

    def emissions(self, batch: WordBatch) -> np.ndarray:
        return batch.sums(self.ngram, NGRAMS, BITS) + self.lexicon[batch.word_feature(LEXICON_BITS)]

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Posterior of each word's label; ``emit`` is by word, text i has rows ``first[i]:first[i + 1]``.

        Texts are cut into segments of ``SEGMENT`` words. Segments of all texts advance together: once
        to get each one's transfer matrix, then, between the segments' exact boundary vectors, forward
        and backward. The result is that of the whole chain.
        """
        k, n = emit.shape[1], np.diff(first)
        parts = -(-n // SEGMENT)
        seg_text = np.repeat(np.arange(len(n)), parts)
        index = np.arange(len(seg_text)) - np.repeat(np.cumsum(parts) - parts, parts)
        seg_begin = first[seg_text] + index * SEGMENT
        size = np.minimum(first[seg_text + 1] - seg_begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size = seg_begin[order], size[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        weight = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64) + 1e-12
        move = np.exp(self.move - self.move.max())
        live = [int(np.searchsorted(-size, -t, side="left")) for t in range(SEGMENT)]  # segments with more than t words
        # transfer matrices: from the label before the segment to that of its last word
        carry = np.tile(np.eye(k), (len(begin), 1, 1))
        for t in range(SEGMENT):
            m = live[t]
            if not m:
                break
            x = (carry[:m].reshape(-1, k) @ move).reshape(m, k, k) * weight[begin[:m] + t][:, None, :]
            carry[:m] = x / x.sum((1, 2), keepdims=True)
        enter, leave = np.empty((len(begin), k)), np.empty((len(begin), k))
        start = np.exp(self.prior - self.prior.max()) @ np.linalg.pinv(move)  # so that the first step gives the prior
        for step in range(int(parts.max()) if len(parts) else 0):
            own = np.flatnonzero(parts > step)
            s = place[np.cumsum(parts)[own] - parts[own] + step]
            if step == 0:
                enter[s] = start
            else:
                prev = place[np.cumsum(parts)[own] - parts[own] + step - 1]
                v = np.einsum("ni,nij->nj", enter[prev], carry[prev])
                enter[s] = v / v.sum(1, keepdims=True)
            s = place[np.cumsum(parts)[own] - 1 - step]
            if step == 0:
                leave[s] = 1.0
            else:
                later = place[np.cumsum(parts)[own] - step]
                v = np.einsum("nij,nj->ni", carry[later], leave[later])
                leave[s] = v / v.sum(1, keepdims=True)
        alpha, beta = np.empty((len(emit), k)), np.empty((len(emit), k))
        a = enter
        for t in range(SEGMENT):
            m = live[t]
            if not m:
                break
            x = (a[:m] @ move) * weight[begin[:m] + t]
            a = x / x.sum(1, keepdims=True)
            alpha[begin[:m] + t] = a
        b = leave.copy()
        for t in range(SEGMENT - 1, -1, -1):
            m = live[t]
            if not m:
                continue
            beta[begin[:m] + t] = b[:m]
            x = (b[:m] * weight[begin[:m] + t]) @ move.T
            b[:m] = x / x.sum(1, keepdims=True)
        out = np.maximum(alpha * beta, 0)
        return out / out.sum(1, keepdims=True)

    def word_posteriors(self, texts):
        """For each text, the posterior of each of its words."""
        batch = WordBatch(texts)
        return batch, self.marginals(self.emissions(batch)[batch.ids], batch.first)

    def predict(self, texts) -> list[tuple[str, float]]:
        out = []
        for a, b in slices(texts, SLICE_CHARS):
            part = texts[a:b]
            if not self.labels:
                out += [(UNKNOWN, 0.0)] * len(part)
                continue
            batch, p = self.word_posteriors(part)
            n = np.diff(batch.first)
            has = np.flatnonzero(n)
            mean = np.zeros((len(n), len(self.labels)))
            if len(has):
                mean[has] = np.add.reduceat(p, batch.first[:-1][has], axis=0) / n[has, None]
            best = mean.argmax(1)
            for text, words, k, m in zip(part, n.tolist(), best.tolist(), mean.tolist()):
                known = words and isinstance(text, str) and has_letter(text)
                out.append((self.labels[k], min(1.0, m[k])) if known else (UNKNOWN, 0.0))
        return out


def train(texts: list, langs: list, batches: int = 400, rate: float = 0.3, seed: int = 5) -> ChainCRF:
    """Adagrad on the chain's likelihood over spliced sequences: runs of words from texts of several languages."""
    crf = ChainCRF(sorted({x for x in langs if x}))
    k = len(crf.labels)
    if not k:
        return crf
    r = np.random.default_rng(seed)
    batch = WordBatch(texts)
    grams = np.stack(batch.features(NGRAMS, BITS), 1)
    size = np.diff(np.append(batch.begin, len(batch.spelled)))
    whole = batch.word_feature(LEXICON_BITS)
    seen = np.bincount(batch.ids, minlength=len(batch.hashes)) >= 3  # the lexicon: words met often enough
    by_label = [np.array([i for i, x in enumerate(langs) if x == y and batch.first[i + 1] > batch.first[i]]) for y in crf.labels]
    usable = [j for j in range(k) if len(by_label[j])]
    if not usable:
        return crf
    memory = {name: np.full(a.shape, 1e-4) for name, a in (("ngram", crf.ngram), ("lexicon", crf.lexicon), ("move", crf.move), ("prior", crf.prior))}

    def step(name, array, grad):
        memory[name] += grad * grad
        array -= (rate * grad / np.sqrt(memory[name])).astype(array.dtype)

    long, wide = 32, 64
    for _ in range(batches):
        at, gold = np.empty((wide, long), np.int64), np.empty((wide, long), np.int64)
        for s in range(wide):
            t = 0
            while t < long:
                y = usable[r.integers(len(usable))]
                d = by_label[y][r.integers(len(by_label[y]))]
                lo, hi = batch.first[d], batch.first[d + 1]
                run = int(min(r.integers(8, long + 1), long - t, hi - lo))
                begin = lo + r.integers(hi - lo - run + 1)
                at[s, t : t + run], gold[s, t : t + run] = batch.ids[begin : begin + run], y
                t += run
        used, ids = np.unique(at, return_inverse=True)
        n = size[used]
        gram_at = np.repeat(batch.begin[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own, owner = grams[gram_at], np.repeat(np.arange(len(used)), n)
        emit = np.where(seen[used, None], crf.lexicon[whole[used]], 0) + np.add.reduceat(crf.ngram[own].sum(1), np.cumsum(n) - n, axis=0)
        emit = emit[ids.ravel()]
        flat = gold.ravel()
        p, pair = _posteriors(crf, emit.reshape(wide, long, k))
        error = p.reshape(-1, k).copy()
        error[np.arange(len(flat)), flat] -= 1
        by_word = np.stack([np.bincount(ids.ravel(), error[:, j], len(used)) for j in range(k)], 1)
        real = own > 0
        grad = np.stack([np.bincount(own[real], np.broadcast_to(by_word[owner, j, None], own.shape)[real], 1 << BITS) for j in range(k)], 1) / wide
        step("ngram", crf.ngram, grad)
        grad = np.stack([np.bincount(whole[used[seen[used]]], by_word[seen[used], j], 1 << LEXICON_BITS) for j in range(k)], 1) / wide
        step("lexicon", crf.lexicon, grad)
        np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        step("move", crf.move, pair / wide)
        step("prior", crf.prior, (p[:, 0].sum(0) - np.bincount(gold[:, 0], minlength=k)) / wide)
    crf.ngram[0] = 0
    return crf


def _posteriors(crf: ChainCRF, emit: np.ndarray):
    """Label posteriors, and expected transitions, of equally long sequences."""
    wide, long, k = emit.shape
    w = np.exp(emit - emit.max(2, keepdims=True)) + 1e-12
    move = np.exp(crf.move - crf.move.max())
    a, b = np.empty_like(w), np.ones_like(w)
    a[:, 0] = w[:, 0] * np.exp(crf.prior - crf.prior.max())
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for t in range(1, long):
        x = (a[:, t - 1] @ move) * w[:, t]
        a[:, t] = x / x.sum(1, keepdims=True)
    for t in range(long - 2, -1, -1):
        x = (b[:, t + 1] * w[:, t + 1]) @ move.T
        b[:, t] = x / x.sum(1, keepdims=True)
    p = a * b
    p /= p.sum(2, keepdims=True)
    edge = a[:, :-1, :, None] * move * (w * b)[:, 1:, None, :]
    edge /= edge.sum((2, 3), keepdims=True)
    return p, edge.sum((0, 1))


def fit(docs: DataFrame, sample: int = 2000, max_chars: int = 200_000, sample_chars: int = 10_000_000) -> ChainCRF:
    """Train on at most ``sample`` rows with a language from the learning folds, those smallest by hash of the id, of ``sample_chars`` together.

    Texts over ``max_chars`` are not learned from (they are labelled whole).
    """
    known = docs.filter(training_fold(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), "lang").filter(F.length("text") <= max_chars)
    picked = bounded_sample(known.select("doc_id", F.length("text").alias("chars")), sample, sample_chars)
    rows = known.join(F.broadcast(picked), "doc_id").limit(2 * sample)  # at most ``sample`` ids
    found = sorted(rows.collect(), key=lambda r: (r.doc_id, r.text, r.lang))
    return train([r.text for r in found], [r.lang for r in found])


def label(docs: DataFrame, crf: ChainCRF, into: str = "language") -> DataFrame:
    """``docs`` with a struct column: the language most of a text's words are in, and the mean posterior of its words.

    Null texts and those without a letter are ``und`` with score 0; ties go to the language first by
    name. Texts are labelled whole; equal texts get equal labels; other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # some MB, whatever the input

    def run(batches):
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(texts.tolist()), columns=RESULT.names)

    return docs.withColumn(into, F.pandas_udf(run, RESULT, F.PandasUDFType.SCALAR_ITER)(F.col("text").cast("string")))


def report(docs: DataFrame, **params) -> DataFrame:
    crf = fit(docs, **params)
    return label(docs.select("doc_id", "text"), crf, "language").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score"
    )
