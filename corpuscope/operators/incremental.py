"""Incremental views: file changes, chunk deltas, embedding caches, symbol shifts, publishing with reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(status: DataFrame) -> DataFrame:
    """(commit, file, status) from raw statuses: a rename deletes the old path and modifies the new one."""
    renamed = F.array(F.struct(F.col("old_path").alias("file"), F.lit("deleted").alias("status")), F.struct(F.col("path").alias("file"), F.lit("modified").alias("status")))
    plain = F.array(F.struct(F.col("path").alias("file"), F.when(F.col("status").startswith("A"), "added").when(F.col("status").startswith("D"), "deleted").otherwise("modified").alias("status")))
    return status.select("commit", F.explode(F.when(F.col("status").startswith("R"), renamed).otherwise(plain)).alias("c")).select("commit", "c.*")


def chunk_delta(old: DataFrame, new: DataFrame, keys=("file", "level", "content_hash")) -> DataFrame:
    """Chunks added and removed, as sets within a file and level."""
    k = list(keys)
    a, b = old.select(*k).distinct(), new.select(*k).distinct()
    return b.join(a, k, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, k, "left_anti").withColumn("change", F.lit("removed")))


def delete_files(chunks: DataFrame, files: DataFrame, level: str | None = None) -> DataFrame:
    gone = chunks.join(files.select("file").withColumn("__gone", F.lit(True)), "file", "left")
    hit = F.col("__gone").isNotNull() & (F.lit(True) if level is None else F.col("level") == level)
    return gone.filter(~hit).drop("__gone")


def live_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.select("content_hash").distinct()


def cache_partition(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted hashes with their vector, or as a miss."""
    return wanted.join(cache, "content_hash", "left").withColumn("hit", F.col("embedding").isNotNull())


def cache_prune(cache: DataFrame, live: DataFrame) -> DataFrame:
    return cache.join(live, "content_hash", "left_semi")


def update_counters(delta: DataFrame, cache: DataFrame) -> DataFrame:
    """What an update does: chunks added and removed, cache hits and their rate."""
    added = delta.filter("change = 'added'").select("content_hash").distinct()
    c = cache_partition(added, cache).agg(F.count_if("hit").alias("cache_hits"), F.count("*").alias("to_embed"))
    n = delta.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    return n.crossJoin(c).withColumn("hit_rate", F.when(F.col("to_embed") > 0, F.col("cache_hits") / F.col("to_embed")).otherwise(0.0))


def shift_spans(symbols: DataFrame, shifts: DataFrame) -> DataFrame:
    """Move spans below each change by its line delta. Shifts: file, after (old line), delta."""
    moved = symbols.join(shifts, "file", "left").groupBy("file", "name", "s", "e").agg(F.coalesce(F.sum(F.when(F.col("after") < F.col("s"), F.col("delta"))), F.lit(0)).alias("delta"))
    return moved.select("file", "name", (F.col("s") + F.col("delta")).alias("s"), (F.col("e") + F.col("delta")).alias("e"))


def delete_subgraph(vertices: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices and edges left without the files, and the edges severed from outside."""
    gone = vertices.join(files, "file", "left_semi").select("vid")
    src, dst = gone.withColumnRenamed("vid", "src"), gone.withColumnRenamed("vid", "dst")
    left = edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti")
    severed = edges.join(src, "src", "left_anti").join(dst, "dst", "left_semi")
    return vertices.join(files, "file", "left_anti"), left, severed


def remap_severed(severed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges to vanished vertices, attached to the vertices of the same name."""
    named = severed.join(old.select(F.col("vid").alias("dst"), "name"), "dst")
    return named.drop("dst").join(new.select("name", F.col("vid").alias("dst")), "name").drop("name")


def publish_plan(units: DataFrame, published: DataFrame, key: str = "reuse_key") -> DataFrame:
    """Which units are reused and which must be written."""
    return units.join(published.select(key).distinct().withColumn("__have", F.lit(True)), key, "left").withColumn("action", F.when(F.col("__have").isNotNull(), "reuse").otherwise("write")).drop("__have")


def manifest_states(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Fresh, stale or missing: a view is fresh if commit, fingerprint and builder all agree."""
    rows = current.join(entries.select("view", F.col("commit").alias("c"), F.col("fingerprint").alias("f"), F.col("builder").alias("b"), "failed"), "view", "left")
    same = (F.col("c") == F.col("commit")) & (F.col("f") == F.col("fingerprint")) & (F.col("b") == F.col("builder"))
    return rows.select("view", F.when(F.col("c").isNull(), "missing").when(F.col("failed"), "failed").when(same, "fresh").otherwise("stale").alias("state"))


def stage_edges(known: DataFrame, staged: DataFrame, identity: list[str], order: str = "seq") -> DataFrame:
    """What one flush adds: staged edges that are not known, each identity once, the first staged."""
    rest = [c for c in staged.columns if c not in identity]
    at = F.when(~F.col("__known"), F.col(order))
    first = F.struct(F.min(at).alias(order)) if rest == [order] else F.min_by(F.struct(*rest), at)  # whole numbers are held in a hash table
    # known and staged rows of an identity meet in one exchange
    both = staged.withColumn("__known", F.lit(False)).unionByName(known.select(*identity).withColumn("__known", F.lit(True)), allowMissingColumns=True)
    one = both.groupBy(*identity).agg(first.alias("r"), F.max("__known").alias("__known"))
    return one.filter(~F.col("__known")).select(*identity, "r.*")


def affected_symbols(symbols: DataFrame, hunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, why): symbols (file, vid, s, e) that a file's changed lines (file, s, e) touch, and those with an edge to or from one."""
    h = hunks.select("file", F.col("s").alias("hs"), F.col("e").alias("he"))
    touched = symbols.join(h, "file").filter("s <= he and hs <= e").select("vid").distinct()
    out = edges.join(touched.select(F.col("vid").alias("src")), "src", "left_semi").select(F.col("dst").alias("vid"), F.lit("target").alias("why"))
    into = edges.join(touched.select(F.col("vid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("vid"), F.lit("source").alias("why"))
    near = out.unionByName(into).distinct().join(touched, "vid", "left_anti")
    return touched.withColumn("why", F.lit("changed")).unionByName(near.groupBy("vid").agg(F.min("why").alias("why")))


def admit(updates: DataFrame, policy: str = "always", verified: DataFrame | None = None, key: str = "update_id") -> DataFrame:
    """Updates that may be published: all (``always``), none before verification (``never``), or those in ``verified``."""
    if policy == "always":
        return updates
    if policy == "never":
        return updates.limit(0)
    if policy != "verified" or verified is None:
        raise ValueError("policy is always, never, or verified with a table")
    return updates.join(verified.select(key).distinct(), key, "left_semi")


def renamed_files(status: DataFrame, suffixes: list[str]) -> DataFrame:
    """(commit, status, file, old_file) of files with one of the suffixes; a rename stays one row with both paths."""
    kind = F.when(F.col("status").startswith("R"), "renamed").when(F.col("status").startswith("A"), "added").when(F.col("status").startswith("D"), "deleted").otherwise("modified")
    own = status.select("commit", kind.alias("status"), F.col("path").alias("file"), F.when(F.col("status").startswith("R"), F.col("old_path")).alias("old_file"))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.col("file").endswith(s) | F.coalesce(F.col("old_file").endswith(s), F.lit(False))
    return own.filter(wanted)


def surface_classes(files: DataFrame, tracked: DataFrame, submodules: DataFrame) -> DataFrame:
    """(file, class): files of a commit's tree (``tracked``), below or at one of its submodules (``submodule``), or ``outside``."""
    parts = F.split("file", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root")
    own = files.select("file").distinct()
    inside = own.select("file", above).join(submodules.select(F.col("file").alias("root")).distinct(), "root").select("file").distinct()
    mark = lambda df, c: df.select("file").distinct().withColumn(c, F.lit(True))
    out = own.join(mark(tracked, "__t"), "file", "left").join(mark(inside, "__s"), "file", "left")
    return out.select("file", F.when(F.col("__t"), "tracked").when(F.col("__s"), "submodule").otherwise("outside").alias("class"))


def convergence(incremental_view: DataFrame, rebuilt: DataFrame, key: list[str]) -> DataFrame:
    """(missing, extra, converged): keys of a rebuilt view that the maintained one lacks or has beside, as multisets."""
    a, b = incremental_view.select(*key), rebuilt.select(*key)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(b.exceptAll(a), "missing").crossJoin(n(a.exceptAll(b), "extra")).withColumn("converged", (F.col("missing") == 0) & (F.col("extra") == 0))
