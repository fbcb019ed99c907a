"""Packing: bounded-space online bin packing of tokenised documents into fixed windows."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import checkpoint, slices, worker_cache

SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_open long"

#: Windows of leftovers are merged in groups of so many partitions.
MERGE_FAN_IN = 64


def load_tokenizer(path: str, ordinary: bool = False):
    """A function from texts to lists of ids, as ``tokenizers`` gives them without adding special tokens.

    The string of a special token in a text is that token's id, or ordinary text if ``ordinary``.
    ``.json`` files open with ``tokenizers``. Where the same vocabulary lies beside it as ranks
    (``.tiktoken``), those are used: equal ids, six times as fast.
    """
    import json
    import os

    ranks_path = path[: -len(".json")] + ".tiktoken" if path.endswith(".json") else path
    special, plain = {}, True
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        special = {t["content"]: t["id"] for t in added}
        # tokens that take in white space around them, or are found in normal form or as whole words alone, are left to ``tokenizers``
        plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if plain and os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        if ordinary or not special:
            return lambda texts: [enc.encode_ordinary(t) for t in texts]
        return lambda texts: [enc.encode(t, allowed_special="all") if any(s in t for s in special) else enc.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = ordinary
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


class Packer:
    """A fixed number of open windows. ``put`` places a piece best-fit; where none fits the fullest window is emitted first."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.rooms: list[tuple[int, int]] = []  # (room left, window), sorted
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, piece, length: int):
        """The pieces of a window that this closes, if any: a list of (piece, offset)."""
        out = None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, w = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.windows:
                _, full = self.rooms.pop(0)
                out = self.held.pop(full)
            room, w = self.size, self.made
            self.held[w] = []
            self.made += 1
        self.held[w].append((piece, self.size - room))
        if room == length:
            return [x for x in (out, self.held.pop(w)) if x]
        insort(self.rooms, (room - length, w))
        return [out] if out else []

    def rest(self):
        out = [self.held.pop(w) for _, w in self.rooms]
        self.rooms = []
        return out


def _pack_partition(path: str, size: int, windows: int, separator: int):
    def run(batches):
        from pyspark import TaskContext

        encode_batch = worker_cache(("tokenizer", path), lambda: load_tokenizer(path))
        part = TaskContext.get().partitionId()
        packer, seq = Packer(size, windows), 0
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(closed, opened):
            nonlocal seq
            out = []
            for window in closed:
                out += [(*piece, (part << 32) + seq, off, opened) for piece, off in window]
                seq += 1
            return out

        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            docs = pdf["doc_id"].tolist()  # as text: a null would make floats of whole numbers
            for a, b in slices(texts, 1 << 19):
                out = []
                for doc, ids in zip(docs[a:b], encode_batch(texts[a:b])):
                    ids = np.asarray([*ids, separator], "<u4")
                    n = len(ids)
                    for s in range(0, n, size):
                        m = min(size, n - s)
                        out += rows(packer.put((doc, s, m, zlib.crc32(ids[s : s + m].tobytes()), n), m), 0)
                if out:
                    yield pd.DataFrame(out, columns=names)
        out = rows(packer.rest(), 1)
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def _merge_group(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """First-fit decreasing over a group's leftover pieces; ties by window and place."""
        rows = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        base, packer = int(pdf["sequence_id"].min()) + (1 << 62), Packer(size, len(pdf) + 1)
        at, off = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        done = 0
        for i, n in enumerate(rows["length"].tolist()):
            for window in packer.put(i, n):
                for j, o in window:
                    at[j], off[j] = base + done, o
                done += 1
        for window in packer.rest():
            for j, o in window:
                at[j], off[j] = base + done, o
            done += 1
        return rows.assign(sequence_id=at, offset=off)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, windows: int = 64, separator: int = 0) -> DataFrame:
    """One row per piece of a document placed in a sequence of at most ``size`` tokens.

    Each partition tokenises its rows once, keeps ``windows`` open windows and emits only piece
    records (no ids), so memory is bounded by ``windows`` and one slice of texts. The windows left
    open at the end of each partition are merged, ``MERGE_FAN_IN`` partitions at a time, so that
    neither the driver nor one task gathers them all. Sequence ids depend on the partition and
    order of the scan alone, so a task that is run again gives the same rows.

    Null or empty text: one piece of one token, the separator. A document longer than a sequence is
    cut at multiples of ``size``. Repeated rows are packed once each; a null doc_id stays null.
    A special token's string in a text is one id, that token's. Other columns are ignored; an empty
    table gives an empty result.
    """
    part = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = checkpoint(part.mapInPandas(_pack_partition(tokenizer, size, windows, separator), SCHEMA))
    closed = pieces.filter("window_open = 0")
    merged = (
        pieces.filter("window_open = 1")
        .groupBy(F.expr(f"shiftright(sequence_id, 32) div {MERGE_FAN_IN}").alias("part_group"))
        .applyInPandas(_merge_group(size), SCHEMA)
    )
    return closed.unionByName(merged).drop("window_open").withColumn("doc_id", F.col("doc_id").cast("long"))
