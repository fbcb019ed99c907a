"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.session import checkpoint  # noqa: F401  the operators take it from here


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of the sieve that rows pass before they are joined with what is wanted of them.
SIEVE_BITS = 24


def sieved(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """``rows`` without most of those whose ``on`` is not in ``wanted``: a bitmap of fixed size, in a broadcast join.

    No row of ``wanted`` is lost; a join has to follow. Null keys go.
    """
    slot = F.pmod(F.xxhash64(on), F.lit(1 << SIEVE_BITS))
    bits = wanted.select(slot.alias("s")).groupBy(F.expr("s div 32768").alias("__bucket")).agg(F.bitmap_construct_agg(F.expr("s % 32768")).alias("__bits"))
    spot = slot % 32768
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.expr("shiftright(__byte, __bit) & 1") == 1
    out = rows.filter(F.col(on).isNotNull()).withColumn("__bucket", F.expr(f"pmod(xxhash64({on}), {1 << SIEVE_BITS}) div 32768"))
    out = out.join(F.broadcast(bits), "__bucket")  # at most 2 ** SIEVE_BITS bits
    return out.withColumn("__byte", byte).withColumn("__bit", (spot % 8).cast("int")).filter(known).select(*rows.columns)


#: Rows of a side that is sent to all executors; copies of a larger one, over which a hot key's rows are dealt.
FEW_ROWS = 200_000
SALTS = 16


def keep_known(rows: DataFrame, known: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Left semi join on keys that may be hot: ``known`` (no repeats) goes round whole if it is small by count.

    Else it is repeated ``SALTS`` times, and the rows of a key are dealt over the copies by ``spread``.
    """
    known = checkpoint(known.select(*on))
    if known.count() <= FEW_ROWS:
        return rows.join(F.broadcast(known), on, "left_semi")
    many = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(many, [*on, "__salt"], "left_semi").drop("__salt")


def bounded_sample(ids: DataFrame, rows: int, chars: int) -> DataFrame:
    """(doc_id) of at most ``rows`` rows of ``ids`` (doc_id, chars), the first by hash of the id whose texts come to ``chars`` together."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = ids.orderBy(*order).limit(rows)
    total = F.sum("chars").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))  # of at most ``rows`` rows
    return few.withColumn("total", total).filter(F.col("total") <= chars).select("doc_id").distinct()


def worker_cache(key, make):
    """A value kept for the life of a Python worker: functions that arrive by value lose their own globals with each task."""
    store = sys.__dict__.setdefault("_corpuscope_worker_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def training_fold(doc_id):
    """True for rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def slices(texts, chars: int = 1 << 20):
    """Cut a sequence of strings into index ranges of about so many characters; a long text stays whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


#: Powers of an odd multiplier modulo 2**64 and of its inverse, for rolling hashes over byte buffers.
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = sys.__dict__.setdefault("_corpuscope_worker_cache", {}).get("powers")
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 21)
        out = []
        for base in (_BASE, _INV):
            p = np.ones(n, np.uint64)
            done = 1
            step = np.uint64(base)
            while done < n:
                m = min(done, n - done)
                p[done : done + m] = p[:m] * step
                step = np.uint64(int(step) * int(step) & (1 << 64) - 1)
                done += m
            out.append(p)
        have = tuple(out)
        sys._corpuscope_worker_cache["powers"] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes that are hashed at once; a longer buffer is cut between words.
_BLOCK = 1 << 20


def word_hashes(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a byte buffer: starts, ends and 64-bit hashes.

    ``table`` maps a byte to a random 64-bit value, or to 0 where the byte separates words.
    """
    out, at = [], 0
    while at < len(buf):
        end = min(at + _BLOCK, len(buf))
        while end < len(buf):
            gaps = np.flatnonzero(table[buf[end : end + 4096]] == 0)
            end = min(end + (int(gaps[0]) if len(gaps) else 4096), len(buf))
            if len(gaps):
                break
        start, stop, h = _hash_block(buf[at:end], table)
        out.append((start + at, stop + at, h))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _hash_block(buf: np.ndarray, table: np.ndarray):
    val = table[buf]
    inside = val != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(val * power[: len(buf)], out=total[1:])
    return start, end, mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def byte_table(separators, lower: bool = True) -> np.ndarray:
    """Random values by byte; A-Z as a-z when ``lower``; 0 for separators."""
    t = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        t[65:91] = t[97:123]
    t[list(separators)] = 0
    return t


def encode(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def joined_words(texts, table: np.ndarray, gap: bytes = b"\n"):
    """Word hashes of many texts at once: hash of each word, and the offset of each text's first word (one more at the end).

    ``gap`` must be a separator in ``table``.
    """
    parts = [encode(t) for t in texts]
    buf = np.frombuffer(gap.join(parts) + gap, np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    start, _, h = word_hashes(buf, table)
    return h, np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)
