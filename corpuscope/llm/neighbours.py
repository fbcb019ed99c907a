"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Unit vectors are hashed by ``TABLES`` tables of ``PROJECTIONS`` Gaussian projections, cut into cells of
``CELL``. A query visits, in each table, its own bucket and perturbed ones in the order of their
estimated success (the sum of squared distances to the cell borders crossed). Buckets and visits are
dealt to groups by table and key; only vectors in visited buckets are scored, by exact cosine, and the
candidates of all tables are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.common import checkpoint, mix64, worker_cache

TABLES = 10
PROJECTIONS = 16
CELL = 3.0
PROBES = 1_000
#: Buckets of a table go to groups of about so many vectors; the vectors and queries that meet in one task.
GROUP_VECTORS = 32_768
BLOCK_VECTORS = 65_536
BLOCK_QUERIES = 4_096
#: Pairs that are scored at once.
PAIRS = 1 << 16


class PStableTables:
    """Hash functions for one dimension; they depend on the seed alone, never on the data."""

    def __init__(self, dim: int, tables: int, projections: int, cell: float, seed: int = 17):
        r = np.random.default_rng([seed, dim])
        self.a = r.standard_normal((tables, dim, projections))
        self.b = r.uniform(0, cell, (tables, projections))
        self.cell = cell
        self.radix = r.integers(1, 1 << 62, projections, dtype=np.int64) | 1

    def cells(self, unit: np.ndarray, t: int):
        y = (unit @ self.a[t] + self.b[t]) / self.cell
        c = np.floor(y)
        return c.astype(np.int64), y - c

    def keys(self, unit: np.ndarray, t: int) -> np.ndarray:
        return self.cells(unit, t)[0] @ self.radix

    def probes(self, unit: np.ndarray, t: int, n: int) -> np.ndarray:
        """The keys of the ``n`` buckets most likely to succeed, for each query, likeliest first.

        Projection by projection, the ``n`` cheapest choices so far are kept: what begins worse cannot end better.
        """
        c, inside = self.cells(unit, t)
        cost, key = np.zeros((len(unit), 1)), (c @ self.radix)[:, None]
        for j in range(c.shape[1]):
            cross = np.stack([inside[:, j] ** 2, np.zeros(len(unit)), (1 - inside[:, j]) ** 2], 1)
            cost = (cost[:, :, None] + cross[:, None, :]).reshape(len(unit), -1)
            key = (key[:, :, None] + np.array([-1, 0, 1]) * self.radix[j]).reshape(len(unit), -1)
            if cost.shape[1] > n:
                best = np.argpartition(cost, n - 1, axis=1)[:, :n]
                cost, key = np.take_along_axis(cost, best, 1), np.take_along_axis(key, best, 1)
        return np.take_along_axis(key, np.argsort(cost, axis=1, kind="stable"), 1)


ROWS = "dim int, t int, g int, kind int, id long, keys binary, v binary"
QUERY, VECTOR = 0, 1


def _packed(v: np.ndarray) -> bytes:
    """A vector in double precision, or in single where that is the same."""
    single = v.astype("<f4")
    return single.tobytes() if (single == v).all() else v.astype("<f8").tobytes()


def _unpacked(rows: list, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8").astype(np.float64) for b in rows])


def _hashed(kind: int, groups: int, tables: int, projections: int, cell: float, probes: int):
    """For each table, a vector's group and key, or a query's groups and the keys that it visits there."""
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches):
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = pdf[dims == dim]
                hashes = worker_cache(("p-stable", dim, tables, projections, cell), lambda: PStableTables(dim, tables, projections, cell))
                for s in range(0, len(rows), 1024):
                    ids = rows["vec_id"].to_numpy()[s : s + 1024]
                    x = np.stack(rows["v"].to_list()[s : s + 1024]).astype(np.float64)
                    unit, packed, out = x / _norm(x)[:, None], [_packed(v) for v in x], []
                    for t in range(tables):
                        keys = hashes.keys(unit, t)[:, None] if kind == VECTOR else hashes.probes(unit, t, probes)
                        group = (mix64(keys.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                        if kind == VECTOR:
                            key = np.ascontiguousarray(keys).tobytes()
                            out += [(dim, t, g, kind, i, key[8 * j : 8 * j + 8], v) for j, (g, i, v) in enumerate(zip(group[:, 0].tolist(), ids.tolist(), packed))]
                            continue
                        for i in range(len(x)):
                            order = np.argsort(group[i], kind="stable")
                            own, begin = np.unique(group[i][order], return_index=True)
                            for g, k in zip(own.tolist(), np.split(keys[i][order], begin[1:])):
                                out.append((dim, t, g, kind, int(ids[i]), k.tobytes(), packed[i]))
                    yield pd.DataFrame(out, columns=names)

    return run


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class Meeting:
    """The queries of one group with the buckets that they visit, and the nearest found so far of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, visits: list[np.ndarray], k: int):
        self.ids, self.vectors, self.norm, self.k = ids, vectors, _norm(vectors), k
        self.everywhere = not any(len(x) for x in visits)
        keys, owner = np.concatenate(visits), np.repeat(np.arange(len(ids)), [len(x) for x in visits])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray):
        norm = _norm(vectors)
        if self.everywhere:
            lo, n = np.zeros(len(ids), np.int64), np.full(len(ids), len(self.ids))
        else:
            lo = np.searchsorted(self.keys, keys)
            n = np.searchsorted(self.keys, keys, side="right") - lo
        ends = np.cumsum(n)
        for s in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(s, min(s + PAIRS, int(ends[-1])))
            v = np.searchsorted(ends, pair, side="right")
            at = lo[v] + pair - (ends[v] - n[v])
            q = at if self.everywhere else self.owner[at]
            q, v = q[self.ids[q] != ids[v]], v[self.ids[q] != ids[v]]
            # pair by pair, so that equal vectors score equally
            score = np.einsum("ij,ij->i", self.vectors[q], vectors[v]) / (self.norm[q] * norm[v])
            good = score >= self.floor[q]
            self._keep(q[good], ids[v[good]], score[good])

    def _keep(self, q, ids, score):
        q, ids, score = (np.append(a, b) for a, b in zip(self.best, (q, ids, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        again = np.zeros(len(q), bool)  # a repeated row counts once
        again[1:] = (q[1:] == q[:-1]) & (ids[1:] == ids[:-1]) & (score[1:] == score[:-1])
        q, ids, score = q[~again], ids[~again], score[~again]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, ids, score, rank = (x[rank < self.k] for x in (q, ids, score, rank))
        self.best = (q, ids, score)
        self.floor[q[rank == self.k - 1]] = score[rank == self.k - 1]


GROUP = ["dim", "t", "g", "vb", "qb"]


def _meet(k: int):
    """Rows come in order of their group, its queries first; what is held is one group's queries and a batch of vectors."""

    def run(batches):
        group, queries, meeting = None, [], None

        def result():
            if meeting is not None and len(meeting.best[0]):
                q, ids, score = meeting.best
                yield pd.DataFrame({"query_id": meeting.ids[q], "vec_id": ids, "score": score})

        for pdf in batches:
            runs = (pdf[[*GROUP, "kind"]] != pdf[[*GROUP, "kind"]].shift()).any(axis=1).to_numpy()
            begin = np.flatnonzero(runs)
            for s, e in zip(begin, np.append(begin[1:], len(pdf))):
                part = pdf.iloc[s:e]
                own = tuple(part[GROUP].iloc[0])
                if own != group:
                    yield from result()
                    group, queries, meeting = own, [], None
                if part["kind"].iloc[0] == QUERY:
                    queries.append(part)
                    continue
                if meeting is None:
                    if not queries:
                        continue  # no query visits this group
                    q = pd.concat(queries)
                    meeting, queries = Meeting(q["id"].to_numpy(), _unpacked(q["v"].tolist(), own[0]), [np.frombuffer(x, np.int64) for x in q["keys"]], k), []
                keys = np.frombuffer(b"".join(part["keys"].tolist()), np.int64)
                meeting.add(part["id"].to_numpy(), _unpacked(part["v"].tolist(), own[0]), keys)
        yield from result()

    return run


def _usable(df: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of finite components, not all of them zero."""
    v = F.col("embedding").cast("array<double>")
    plain = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    some = F.exists(v, lambda x: x != 0)
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null")
    return own.filter(plain).filter(some).select("vec_id", v.alias("v"))


def _dealt(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Both sides' rows by group; a group of very many vectors or queries is cut in blocks, and each block of one meets each of the other."""
    own = ["dim", "t", "g"]
    many = F.sum(F.when(F.col("kind") == VECTOR, 1).otherwise(0)), F.sum(F.when(F.col("kind") == QUERY, 1).otherwise(0))
    rows = vectors.select(*own, "kind").unionByName(queries.select(*own, "kind"))
    blocks = rows.groupBy(*own).agg(F.ceil(many[0] / BLOCK_VECTORS).cast("int").alias("vbs"), F.ceil(many[1] / BLOCK_QUERIES).cast("int").alias("qbs")).filter("vbs > 0 and qbs > 0")
    blocks = checkpoint(blocks)
    side = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = vectors.join(blocks, own).withColumn("vb", side("vbs")).withColumn("qb", every("qbs"))
    q = queries.join(blocks, own).withColumn("qb", side("qbs")).withColumn("vb", every("vbs"))
    columns = [*GROUP, "kind", "id", "keys", "v"]
    return v.select(*columns).unionByName(q.select(*columns)).repartition(*GROUP).sortWithinPartitions(*GROUP, "kind")


def _everywhere(rows: DataFrame, kind: int, groups: int) -> DataFrame:
    """Rows for a scan without buckets: vectors by their id, queries to each of ``groups``."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"dim": pdf["v"].map(len), "id": pdf["vec_id"], "v": [_packed(np.asarray(x, np.float64)) for x in pdf["v"]]})

    own = rows.mapInPandas(run, "dim int, id long, v binary")
    g = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int") if kind == VECTOR else F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    keys = F.lit(b"\0" * 8 if kind == VECTOR else b"")
    return own.select("dim", F.lit(-1).alias("t"), g.alias("g"), F.lit(kind).alias("kind"), "id", keys.alias("keys"), "v")


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    found = _dealt(vectors, queries).mapInPandas(_meet(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, projections: int = PROJECTIONS, cell: float = CELL, probes: int = PROBES, group_vectors: int = GROUP_VECTORS) -> DataFrame:
    """The ``k`` nearest found of each query among all ``vectors`` but those of its own vec_id.

    Result: query_id, rank from 1, vec_id, score (cosine in double precision of the original vectors);
    ties go to the smaller vec_id. Both tables have vec_id and embedding. Vectors are dealt out once for
    each table by the group of their bucket, queries once for each group that holds a bucket they visit.
    Very common buckets are cut in blocks, so that a task holds at most ``BLOCK_QUERIES`` queries and a
    batch of vectors; each returns at most ``k`` rows a query. Nothing passes through the driver but counts.

    Vectors that are null, all zeros, or hold a null or non-finite component take no part; neither do
    null ids. Vectors of different lengths are not compared. Of query rows that repeat an id the
    smallest vector counts; candidate rows that repeat an id and vector count once. A query that finds fewer
    than ``k`` in its buckets is compared with all vectors. Empty tables: no rows.
    """
    vectors = _usable(vectors)
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    asked = checkpoint(_usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(spread, "vec_id"))
    groups = max(1, -(-vectors.count() // group_vectors))
    params = (groups, tables, projections, cell, probes)
    visits = checkpoint(asked.mapInPandas(_hashed(QUERY, *params), ROWS))  # counted, then dealt
    found = checkpoint(_nearest(vectors.mapInPandas(_hashed(VECTOR, *params), ROWS), visits, k))
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = checkpoint(asked.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    # too few in the buckets visited: once more, in all
    again = _nearest(_everywhere(vectors, VECTOR, groups), _everywhere(short, QUERY, groups), k)
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)


def report(embeddings: DataFrame, every: int = 50, k: int = 5, **params) -> DataFrame:
    return search(embeddings, embeddings.filter(F.col("vec_id") % every == 0), k, **params)
