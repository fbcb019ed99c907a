"""Catalog of snapshots: content ids, idempotent inserts, manifest joins, integrity, job folding."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows not there yet; an insert that is done again adds nothing."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def manifest(snapshot_views: DataFrame, generations: DataFrame, profiles: DataFrame, objects: DataFrame) -> DataFrame:
    """What a snapshot consists of: its views with their generation, profile and object."""
    return snapshot_views.join(generations, "generation_id").join(profiles, "profile_id").join(objects, "object_id")


def broken_views(snapshot_views: DataFrame, generations: DataFrame) -> DataFrame:
    """Views of a snapshot whose generation is not ready, or of another source."""
    ready = generations.filter(F.col("status") == "ready").select("generation_id", "source_id")
    return snapshot_views.join(ready, ["generation_id", "source_id"], "left_anti")


def fold_jobs(events: DataFrame, job: str, order: str, status: str) -> DataFrame:
    """Last state of each job, how many transitions, and its fencing token: the number of leases."""
    return events.groupBy(job).agg(F.max_by(status, order).alias("state"), F.count("*").alias("transitions"), F.count_if(F.col(status) == "view").alias("token"))


def fold_leases(events: DataFrame) -> DataFrame:
    """(job, state, token, worker, expires, refused): jobs as their events leave them, in order of ``seq``.

    Events: job, seq, kind (create, lease, renew, finish, fail, cancel), worker, token, at, ttl. A lease is given to a
    job that waits or whose lease has run out, and raises its fencing token; whoever renews, finishes or fails
    must name the token that holds and come in time. Refused events change nothing but their count.
    """
    one = F.struct("seq", "kind", "worker", "token", "at", "ttl")
    start = F.struct(
        F.lit(None).cast("string").alias("state"), F.lit(0).cast("long").alias("token"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("long").alias("expires"), F.lit(0).cast("long").alias("refused")
    )

    def step(acc, e):
        kind, state = e["kind"], acc["state"]
        free = (state == "queued") | ((state == "leased") & (acc["expires"] <= e["at"]))
        holds = (state == "leased") & (acc["token"] == e["token"]) & (acc["expires"] > e["at"])
        made = lambda s, token, worker, expires: F.struct(F.lit(s).alias("state"), token.cast("long").alias("token"), worker.alias("worker"), expires.cast("long").alias("expires"), acc["refused"].alias("refused"))
        none, nobody = F.lit(None).cast("long"), F.lit(None).cast("string")
        no = F.struct(state.alias("state"), acc["token"].alias("token"), acc["worker"].alias("worker"), acc["expires"].alias("expires"), (acc["refused"] + 1).alias("refused"))
        return (
            F.when((kind == "create") & state.isNull(), made("queued", acc["token"], nobody, none))
            .when((kind == "lease") & free, made("leased", acc["token"] + 1, e["worker"], e["at"] + e["ttl"]))
            .when((kind == "renew") & holds, made("leased", acc["token"], acc["worker"], e["at"] + e["ttl"]))
            .when((kind == "finish") & holds, made("finished", acc["token"], acc["worker"], none))
            .when((kind == "fail") & holds, made("queued", acc["token"], nobody, none))
            .when((kind == "cancel") & state.isin("queued", "leased"), made("cancelled", acc["token"], acc["worker"], none))
            .otherwise(no)
        )

    folded = events.groupBy("job").agg(F.aggregate(F.sort_array(F.collect_list(one)), start, step).alias("s"))
    return folded.select("job", "s.*")


class Catalog:
    """Snapshots in parquet below one shared folder.

    A ref is a folder of numbered versions, each written aside and renamed into place, which fails where the
    number is taken: of two writers that saw the same version one goes through. Nothing is ever replaced.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def stage(self, view: str, df: DataFrame) -> str:
        """Write a generation; nothing refers to it yet."""
        name = f"{view}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/generations/{name}")
        return name

    def versions(self, ref: str) -> list[int]:
        path, fs = self._path("refs", ref)
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def resolve(self, ref: str, version: int | None = None) -> dict | None:
        """The views of a ref now, or at an earlier version."""
        known = self.versions(ref)
        if not known or (version is not None and version not in known):
            return None
        path, _ = self._path("refs", f"{ref}/{known[-1] if version is None else version:012d}")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def publish(self, ref: str, views: dict[str, str], expected: str | None) -> str:
        """Point a ref at new views if it still is where the caller saw it."""
        known = self.versions(ref)
        if (self.resolve(ref) or {}).get("snapshot") != expected:
            raise RuntimeError(f"ref {ref} has moved")
        snapshot = uuid.uuid4().hex
        path, fs = self._path("refs", f"{ref}/{(known[-1] if known else 0) + 1:012d}")
        aside, _ = self._path("refs", f"{ref}/.{snapshot}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"snapshot": snapshot, "views": views}).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
            raise RuntimeError(f"ref {ref} has moved")
        return snapshot

    def read(self, ref: str, view: str) -> DataFrame:
        found = self.resolve(ref)
        if not found:
            raise KeyError(ref)
        return self.spark.read.parquet(f"{self.root}/generations/{found['views'][view]}")


