"""Fact algebra: monikers resolve where exactly one definition matches; batches merge, diff and converge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import checkpoint


def scope(symbol, file):
    """Symbols ``local ...`` belong to their file."""
    return F.when(symbol.startswith("local "), file).otherwise(F.lit(""))


def resolve_monikers(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges (eid, file, moniker) with the one definition of their moniker, or null where none or several match."""
    defs = definitions.withColumn("scope", scope(F.col("moniker"), F.col("file"))).groupBy("scope", "moniker").agg(F.count("*").alias("n"), F.min("symbol_id").alias("target"))
    own = edges.withColumn("scope", scope(F.col("moniker"), F.col("file")))
    return own.join(defs.filter("n = 1").drop("n"), ["scope", "moniker"], "left").drop("scope")


def resolve_in_file(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Symbol ids of the same file only."""
    return edges.join(definitions.select("file", "symbol_id").distinct().withColumn("resolved", F.lit(True)), ["file", "symbol_id"], "left").fillna(False, ["resolved"])


def synthesize(rules: DataFrame, definitions: DataFrame) -> DataFrame:
    """An edge for each rule (source_moniker, target_moniker) whose ends are both unique."""
    one = definitions.groupBy("moniker").agg(F.count("*").alias("n"), F.min("symbol_id").alias("id")).filter("n = 1").drop("n")
    a, b = one.select(F.col("moniker").alias("source_moniker"), F.col("id").alias("source")), one.select(F.col("moniker").alias("target_moniker"), F.col("id").alias("target"))
    return rules.join(a, "source_moniker").join(b, "target_moniker")


def resolver_report(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("*").alias("edges"), F.count("target").alias("resolved"), (F.count("*") - F.count("target")).alias("unresolved"))


def merge_batches(batches: DataFrame, file: str = "file", fact: str = "fact") -> DataFrame:
    """One batch a file: its distinct facts in order, their number and digest."""
    return batches.groupBy(file).agg(F.sort_array(F.collect_set(fact)).alias("facts")).select(file, F.size("facts").cast("long").alias("n_facts"), F.sha2(F.array_join("facts", "\n"), 256).alias("digest"))


def overlay(events: DataFrame, key: str, order: str, deleted: str = "deleted") -> DataFrame:
    """Latest upsert of each key; deletions remove it."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("r")).select(key, "r.*")
    return last.filter(~F.col(deleted)).drop(deleted)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys missing from, extra in, or changed in the new snapshot."""
    a, b = old.select(key, F.col(digest).alias("a")), new.select(key, F.col(digest).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").withColumn("state", state).filter("state is not null").select(key, "state")


def symbol_diff(old: DataFrame, new: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols of a file before and after a change: deleted, added, affected (a hunk meets the old span), shifted, unchanged.

    Symbols: file, name, s, e. Hunks: file, hs, he (old lines).
    """
    a = old.select("file", "name", F.col("s").alias("os"), F.col("e").alias("oe"))
    b = new.select("file", "name", F.col("s").alias("ns"), F.col("e").alias("ne"))
    both = a.join(b, ["file", "name"], "full_outer")
    met = a.join(hunks, "file").filter("os <= he and hs <= oe").select("file", "name").distinct().withColumn("met", F.lit(True))
    state = (
        F.when(F.col("ns").isNull(), "deleted").when(F.col("os").isNull(), "added").when(F.col("met").isNotNull() | ((F.col("oe") - F.col("os")) != (F.col("ne") - F.col("ns"))), "affected")
        .when(F.col("os") != F.col("ns"), "shifted").otherwise("unchanged")
    )
    return both.join(met, ["file", "name"], "left").select("file", "name", state.alias("state"), (F.col("ns") - F.col("os")).alias("shift"))


def occurrences_to_batches(occurrences: DataFrame) -> DataFrame:
    """One batch a file; the definition bit makes a symbol fact; completeness is partial, there are no edges."""
    is_def = F.col("roles").bitwiseAND(1) == 1
    return occurrences.groupBy("file").agg(
        F.count("*").alias("n_occurrences"), F.count_if(is_def).alias("n_symbols"), F.lit("partial").alias("completeness"),
        F.sort_array(F.collect_set(F.when(is_def, F.col("symbol")))).alias("symbols"),
    )


def graph_to_batches(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: half-open full-line spans of its symbols, and its outgoing edges."""
    v = vertices.filter("file is not null").groupBy("file").agg(F.count("*").alias("n_symbols"), F.min("start_line").alias("first_line"), F.max(F.col("end_line") + 1).alias("past_line"))
    e = edges.join(vertices.select(F.col("vid").alias("src"), "file"), "src").filter("file is not null").groupBy("file").agg(F.count("*").alias("n_edges"))
    return v.join(e, "file", "left").fillna(0, ["n_edges"])


#: Pairs of a reference and a definition that one block of files may have; with fewer for each row, the pairs are shuffled as they are.
BLOCK_PAIRS, FEW_PAIRS = 1 << 25, 8
IMPORTS = "source long, target long, anchor_line long"


def _targets(batches):
    """Rows of a block in order: its definitions, then its references by source, the last lines first. One row a source and target."""
    block, known, at, buffer, size = None, {}, None, [], 0

    def ended(source, rows):
        """Targets of one source, each with the least line."""
        held = [(known[symbol], line) for symbol, line in rows if symbol in known]
        if not held:
            return None
        best = np.full(len(names), LAST)
        for targets, line in held:  # lines fall, so the least is written last
            best[targets] = line
        found = np.flatnonzero((best < LAST) & (names != source))
        return np.full(len(found), source), names[found], best[found]

    def frame():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*buffer)], names=["source", "target", "anchor_line"])

    pending, defs = [], []
    LAST = np.iinfo(np.int64).max
    names = np.zeros(0, np.int64)
    for batch in batches:
        b, side, file, symbol, line = (batch.column(c).to_numpy() for c in ("block", "side", "file", "symbol", "line"))
        cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(side) != 0) | ((np.diff(file) != 0) & (side[1:] == 1))) + 1
        for start, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(b)).tolist()):
            if start == end:
                continue
            now = (int(b[start]), int(file[start]) if side[start] else None)
            if at is not None and now != at:
                out = ended(at[1], pending) if at[1] is not None else None
                pending = []
                if out is not None:
                    buffer.append(out)
                    size += len(out[0])
                if size > 1 << 18:
                    yield frame()
                    buffer, size = [], 0
            at = now
            if now[0] != block:
                block, known, defs = now[0], {}, []
                names = np.zeros(0, np.int64)
            if now[1] is None:
                defs.append((symbol[start:end], file[start:end]))
                continue
            if defs:
                symbols, files = (np.concatenate(x) for x in zip(*defs))
                names, place = np.unique(files, return_inverse=True)
                order = np.argsort(symbols, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(symbols[order]) != 0))
                known, defs = dict(zip(symbols[order][first].tolist(), np.split(place[order], first[1:]))), []
            pending += zip(symbol[start:end].tolist(), line[start:end].tolist())
    if at is not None and at[1] is not None and (out := ended(at[1], pending)) is not None:
        buffer.append(out)
    if buffer:
        yield frame()


def import_edges(spans: DataFrame, occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """File to file: a reference inside an import span points at the file that defines its symbol.

    Files that share many symbols make very many pairs of a reference and a definition, often all pairs of files. Then
    sources and targets are dealt to blocks, every block of sources meets every block of targets in one task, and no pair
    is shuffled; a row goes to as many tasks as there are blocks of a side. Files and symbols must be whole numbers for that.
    """
    from corpuscope.operators.intervals import overlap_join

    refs = occurrences.filter(F.col("roles").bitwiseAND(1) == 0).select("file", F.col("start_line").alias("rs"), F.col("start_line").alias("re"), "symbol")
    hits = overlap_join(spans.select("file", F.col("s").alias("ls"), F.col("e").alias("le")), refs, "file", "ls", "le", "rs", "re")
    hits = checkpoint(hits.filter("symbol is not null").groupBy("file", "symbol").agg(F.min("rs").alias("rs")))
    # only what is referred to
    targets = checkpoint(definitions.select("symbol", F.col("file").alias("target")).filter("target is not null").distinct().join(hits.select("symbol").distinct(), "symbol", "left_semi"))
    n = hits.groupBy("symbol").agg(F.count("*").alias("r")).join(targets.groupBy("symbol").agg(F.count("*").alias("d")), "symbol")
    size = n.agg(F.sum(F.col("r").cast("double") * F.col("d")).alias("pairs"), F.sum(F.col("r") + F.col("d")).alias("rows")).first()
    whole = all(k in ("bigint", "int") for k in (dict(hits.dtypes)["file"], dict(hits.dtypes)["symbol"], dict(targets.dtypes)["target"]))
    if not whole or not size.pairs or size.pairs <= FEW_PAIRS * size.rows:
        return hits.join(targets, "symbol").filter("file <> target").groupBy(F.col("file").alias("source"), "target").agg(F.min("rs").alias("anchor_line"))
    side = math.ceil(math.sqrt(size.pairs / BLOCK_PAIRS))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    rows = targets.withColumn("b", every).select((F.col("b") * side + own("target")).alias("block"), F.lit(0).alias("side"), F.col("target").cast("long").alias("file"), F.col("symbol").cast("long").alias("symbol"), F.lit(0).cast("long").alias("line"))
    rows = rows.unionByName(hits.withColumn("b", every).select((own("file") * side + F.col("b")).alias("block"), F.lit(1).alias("side"), F.col("file").cast("long").alias("file"), F.col("symbol").cast("long").alias("symbol"), F.col("rs").cast("long").alias("line")))
    return rows.repartition(2 * side * side, "block").sortWithinPartitions("block", "side", "file", F.desc("line")).mapInArrow(_targets, IMPORTS)
