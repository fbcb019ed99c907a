"""N-gram Jaccard join: blocked sparse products of document by n-gram incidence, pruned by size-derived bounds.

Documents with equal n-gram sets form one class. Each class's n-grams are put in one global order, rare
first. Two sets whose similarity reaches the threshold must share n-grams among the first few of both
(their prefixes). The order knows rare n-grams by hashed counts only, which tell less the larger the table
is; so a prefix is sent half as long again, the prefixes it is found in are counted exactly, and as many of
its most common n-grams go as the longer prefixes of two such sets must share besides the first. The product
runs over what is left: overlap counts are accumulated by pair, and pairs whose count is below the bound
that their sizes imply go. n-grams in very many prefixes would
make all pairs of a group; there each document is tied to one of like size instead, by star. What is left
ties classes into small clusters. A second product over the whole sets decides every pair within a cluster
that could still join two components. A large cluster is cut in blocks: first each block is linked within
and with some heads of the cluster; then only what is not of the largest component meets the other blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.common import byte_table, checkpoint, joined_words, mix64, sieved, slices
from corpuscope.llm.components import connected_components

#: Words are runs of anything but ASCII white space; A-Z count as a-z.
SEPARATORS = [0x20, *range(0x09, 0x0E)]

#: n-grams are counted in so many hash buckets for the global order: a table of fixed size.
ORDER_BITS = 22
BLOCK_BITS = 12

#: Of n-grams in so many prefixes pairs are made; of more, stars: these are one row a prefix row, pairs half as many as the prefixes.
PAIRED = 8
#: From so many prefix rows of an n-gram in one batch on, stars are made before the shuffle.
HOT = 48

#: n-grams of the sets that meet in one block of a cluster; classes of a large cluster that every block meets.
BLOCK_NGRAMS = 2_000_000
HEADS = 4

SLICE_CHARS = 1 << 20
#: Rows whose texts are Python strings at a time; prefix rows that are tied and sent together.
SLICE_ROWS = 1024
SEND_ROWS = 1 << 19


def shingle_sets(texts, n: int, table):
    """The sorted distinct n-gram hashes of each text; a shorter text has its whole word sequence as one."""
    for a, b in slices(texts, SLICE_CHARS):
        h, first = joined_words(texts[a:b], table)
        for i in range(b - a):
            w = h[first[i] : first[i + 1]]
            k = min(n, len(w))
            if not k:
                yield np.zeros(0, np.uint64)
                continue
            g = np.zeros(len(w) - k + 1, np.uint64)
            for j in range(k):
                g = g * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(g)]
            yield np.unique(mix64(g + np.uint64(k)))


def class_of(s: np.ndarray) -> int:
    """A 64-bit key of an n-gram set: equal sets, equal keys. Null for an empty set."""
    with np.errstate(over="ignore"):
        h = mix64(np.array([len(s)], np.uint64) + s.sum() * np.uint64(0x9E3779B97F4A7C15) ^ mix64(s ^ np.uint64(0xD6E8FEB86659FD93)).sum())
    return int(h.view(np.int64)[0])


def required(theta: int, a, b):
    """Least overlap of sets of sizes a and b with similarity theta / 100 or more."""
    return -(-theta * (a + b) // (100 + theta))


def prefix_length(n, theta: int):
    """So many n-grams of a set of ``n``, in any one order, hold one that a set of similarity theta / 100 or more has as well."""
    return n - -(-theta * n // 100) + 1


def surplus(n, theta: int):
    """By so many n-grams a prefix is sent longer. It never falls as ``n`` rises."""
    p = prefix_length(n, theta)
    return min(p // 2, n - p)


def spare(n, theta: int):
    """So many n-grams of a longer prefix need not be looked at: the least surplus of a set of like size.

    The longer prefixes of two like sets share the first 1 + (the smaller surplus) of all that the two share,
    so in whatever order each of them may leave out its last ``spare``.
    """
    return surplus(-(-theta * n // 100), theta)


def _texts(batches):
    """The texts of Arrow batches, some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.column("text").slice(at, SLICE_ROWS).to_pylist()


def _classes(n: int, table):
    def run(batches):
        for texts in batches:
            rows = [(len(s), class_of(s) if len(s) else None) for at in range(0, len(texts), SLICE_ROWS) for s in shingle_sets(texts[at : at + SLICE_ROWS].tolist(), n, table)]
            yield pd.DataFrame({"n": np.array([r[0] for r in rows], np.int64), "class": pd.array([r[1] for r in rows], "Int64")})

    return F.pandas_udf(run, "n long, class long", F.PandasUDFType.SCALAR_ITER)


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _bucket_counts(n: int, table):
    """Counts by bucket, up to 255 a task, one byte each: (block, counts) for every run of 2 ** ``BLOCK_BITS`` buckets."""

    def run(batches):
        counts = np.zeros(1 << ORDER_BITS, np.uint32)
        for texts in _texts(batches):
            for s in shingle_sets(texts, n, table):
                np.add.at(counts, bucket_of(s), np.uint32(1))
        blocks = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << BLOCK_BITS)
        some = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(some), 128):
            own = some[at : at + 128]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([blocks[i].tobytes() for i in own], pa.binary())], names=["block", "counts"])

    return run


def _block_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for counts in pdf["counts"]:
        total += np.frombuffer(counts, np.uint8)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})


def bucket_counts(text: DataFrame, n: int, table) -> np.ndarray:
    """How often n-grams of all texts fall in each bucket, about: a table of fixed size, of two bytes a bucket."""
    parts = text.mapInArrow(_bucket_counts(n, table), "block int, counts binary")
    counts = np.zeros((1 << (ORDER_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint16)
    for row in parts.groupBy("block").applyInPandas(_block_sums, "block int, counts binary").toLocalIterator():
        counts[row.block] = np.frombuffer(row.counts, "<u2")
    return counts.ravel()


def tied_here(gram: np.ndarray, key: np.ndarray, band: np.ndarray, here: int):
    """Of a batch's prefix rows: which to send, which are of an n-gram that is common here, and ties (row, other row).

    Sizes are alike if their bands are at most one apart. Of an n-gram with more than ``here`` rows each row is
    tied to the first of those in its band or the one before, and of those in its band or the next; rows that
    are first nowhere stay behind.
    """
    send, hot = np.ones(len(gram), bool), np.zeros(len(gram), bool)
    _, of, count = np.unique(gram, return_inverse=True, return_counts=True)
    own = np.flatnonzero(count[of.ravel()] > here)
    if not len(own):
        return send, hot, own, own
    hot[own], send[own] = True, False
    row, group = np.append(own, own), np.append(band[own], band[own] + 1)
    order = np.lexsort((key[row], group, gram[row]))
    row, group = row[order], group[order]
    new = np.append(True, (gram[row[1:]] != gram[row[:-1]]) | (group[1:] != group[:-1]))
    head = row[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
    send[row[new]] = True
    return send, hot, row[~new], head[~new]


PREFIXES = "gram long, class long, n long, band int, hot boolean, held int, tie long"


def _prefixes(n: int, theta: int, table, order, here: int):
    """Rows of the longer prefixes, and ties between classes (``tie`` is the other one) in place of those of n-grams common in a batch.

    ``held`` is how many rows of a class stayed behind.
    """
    step = math.log(100 / theta) * 1.0001  # like sizes are at most one band apart

    def rows(grams, classes, sizes):
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        gram, key, size = np.concatenate(grams).view(np.int64), np.array(classes, np.int64)[of], np.array(sizes, np.int64)[of]
        band = np.floor(np.log(size) / step).astype(np.int32)
        send, hot, one, two = tied_here(gram, key, band, here)
        held = np.bincount(of[~send], minlength=len(grams)).astype(np.int32)[of]
        ties = np.unique(np.column_stack([key[one], key[two]]), axis=0) if len(one) else np.zeros((0, 2), np.int64)
        some = np.flatnonzero(send)
        for at in range(0, len(some), 1 << 16):
            own = some[at : at + (1 << 16)]
            columns = [pa.array(x[own]) for x in (gram, key, size, band, hot, held)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(own), pa.int64())], names=names)
        if len(ties):  # a tie travels by its class
            none = np.zeros(len(ties), np.int64)
            columns = [ties[:, 0], ties[:, 0], none, none.astype(np.int32), none > 0, none.astype(np.int32), ties[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

    names = [x.split()[0] for x in PREFIXES.split(", ")]

    def run(batches):
        counts, seen = order.value, set()
        for batch in batches:
            grams, classes, sizes, total = [], [], [], 0
            for texts in _texts([batch]):
                for s in shingle_sets(texts, n, table):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)  # copies in one partition: once
                    p = prefix_length(len(s), theta) + surplus(len(s), theta)
                    grams.append(s[np.lexsort((s, counts[bucket_of(s)]))[:p]])
                    classes.append(c)
                    sizes.append(len(s))
                    total += p
                    if total >= SEND_ROWS:
                        yield from rows(grams, classes, sizes)
                        grams, classes, sizes, total = [], [], [], 0
            if grams:
                yield from rows(grams, classes, sizes)

    return run


def _sets(n: int, table):
    def run(batches):
        for pdf in (batch.iloc[at : at + SLICE_ROWS] for batch in batches for at in range(0, len(batch), SLICE_ROWS)):
            sets = list(shingle_sets(pdf["text"].tolist(), n, table))
            same = [len(s) > 0 and class_of(s) == c for s, c in zip(sets, pdf["class"].tolist())]
            out = pdf[["root", "class", "blocks", "head"]].assign(grams=[s.tobytes() for s in sets])
            yield out[same]

    return run


def link_block(keys: np.ndarray, sets: list[np.ndarray], theta: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as (key, root key), of the links among some sets.

    Rows of the sparse product are made one by one, by the set's postings. A row is needed only while
    some set without a row of its own lies in another component. ``known`` labels sets that are of one
    component already.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    by_gram = np.argsort(gram, kind="stable")
    posting = owner[by_gram]
    df = np.bincount(gram)
    post_end = np.cumsum(df)
    post_begin = post_end - df
    at = np.concatenate(([0], np.cumsum(size)))
    central = np.add.reduceat(df[gram].astype(np.float64), at[:-1]) / size
    # of each set, kept flat
    root = np.arange(m) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1].ravel()]
    given = root.copy()
    open_ = np.ones(m, bool)
    i = int(central.argmax()) if known is None else int(np.bincount(root, minlength=m)[root].argmin())
    while True:
        open_[i] = False
        g = gram[at[i] : at[i + 1]]
        n = df[g]
        spots = np.repeat(post_begin[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        overlap = np.bincount(posting[spots], minlength=m)
        linked = np.flatnonzero(overlap >= required(theta, size[i], size))
        roots = np.unique(root[linked])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
        rest = np.flatnonzero(open_)
        if not len(rest):
            break
        members = np.bincount(root[rest], minlength=m)
        if (members > 0).sum() == 1:
            break  # every pair still open lies within one component
        own = members[root[rest]]
        i = int(rest[np.lexsort((-central[rest], own))[0]])  # the smallest component first
    if known is None:
        return [(int(keys[k]), int(keys[root[k]])) for k in range(m) if root[k] != k]
    return [(int(keys[k]), int(keys[root[k]])) for k in np.unique(given).tolist() if root[k] != k]


def _link_texts(n: int, theta: int, table):
    """As ``_link_group``, of texts: these are half as large as their sets when they are dealt."""
    link = _link_group(theta)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[["class", "text"]]
        sets = list(shingle_sets(pdf["text"].tolist(), n, table))
        same = [len(s) > 0 and class_of(s) == c for s, c in zip(sets, pdf["class"].tolist())]
        return link(pdf[["class"]].assign(grams=sets)[same])

    return run


def _link_group(theta: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class").sort_values("class")
        known = pdf["label"].to_numpy() if "label" in pdf else None
        links = link_block(pdf["class"].to_numpy(), [np.frombuffer(b, np.uint64) for b in pdf["grams"]], theta, known) if len(pdf) > 1 else []
        return pd.DataFrame(links, columns=["a", "b"]).astype(np.int64)

    return run


def components(docs: DataFrame, n: int = 5, theta: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked, directly or not, by n-gram sets of similarity theta % or more.

    ``component_id`` is the smallest doc_id of the component. A text of fewer than ``n`` words has its
    whole sequence as its one n-gram; null texts and texts without words are empty and linked with
    nothing. Equal texts are linked; repeated rows come back as often. Rows without an id take part in
    links, but name no component: theirs is the smallest id in it, or null. All texts are read whole.
    Intermediate tables: prefixes (about 1.5 * (100 - theta) % of the n-grams, one row each), candidate pairs,
    and the sets of those classes alone that are in a cluster. Keys are 64-bit hashes.
    """
    table = byte_table(SEPARATORS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows without an id are told apart by their text
    rid = F.coalesce("doc_id", F.xxhash64("text")).alias("rid")
    keyed = checkpoint(docs.select("doc_id", rid, _classes(n, table)("text").alias("s")).select("doc_id", "rid", "s.n", "s.class"))
    text = docs.select("text")

    # the order: bucket counts over all documents, a table of fixed size
    order = docs.sparkSession.sparkContext.broadcast(bucket_counts(text, n, table))

    prefixes = checkpoint(_rarest(_shared(text.mapInArrow(_prefixes(n, theta, table, order, HOT), PREFIXES)), theta))
    cool = prefixes.filter(f"tie is null and not hot and df <= {PAIRED}").select("gram", "class", "n")
    x, y = cool.alias("x"), cool.alias("y")
    pairs = (
        x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.n") * 100 >= F.col("y.n") * theta) & (F.col("y.n") * 100 >= F.col("x.n") * theta))
        .groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        .agg(F.count("*").alias("c"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    )
    # what two sets share beyond the longer prefixes, and in what these leave out; sets that share a hot n-gram are tied by it
    beyond = lambda c: F.expr(f"{c} - {_prefix_length(c, theta)} - {_surplus(c, theta)}")
    left_out = F.greatest(F.expr(_spare("na", theta)), F.expr(_spare("nb", theta)))
    least = F.ceil(F.lit(theta) * (F.col("na") + F.col("nb")) / F.lit(100.0 + theta) - 1e-9)
    pairs = pairs.filter(F.col("c") >= least - F.greatest(beyond("na"), beyond("nb")) - left_out)
    hot = prefixes.filter(f"tie is null and (hot or df > {PAIRED})").select("gram", "class", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    star = hot.groupBy("gram", "band").agg(F.min("class").alias("b"))
    stars = hot.join(star, ["gram", "band"]).select(F.col("class").alias("a"), "b").filter("a <> b").distinct()
    stars = stars.unionByName(prefixes.filter("tie is not null").select(F.col("class").alias("a"), F.col("tie").alias("b")))
    clusters = checkpoint(connected_components(pairs.select("a", "b").union(stars)))

    # whole sets of the classes in a cluster, in blocks
    id_or_text = F.min(F.when(F.col("doc_id").isNull(), F.col("rid")))
    some = keyed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), id_or_text).alias("rid"), F.min("n").alias("n"), F.count("*").alias("copies"))
    own = clusters.join(some, clusters["node"] == some["class"]).select("root", "class", "rid", "n")
    sizes = own.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK_NGRAMS))).cast("int").alias("blocks"))
    own = own.join(sizes, "root").withColumn("head", F.lit(False))
    large = checkpoint(own.filter("blocks > 1"))
    some_large = not large.isEmpty()
    if some_large:
        first = large.groupBy("root").agg(F.array(*[F.min_by("class", F.xxhash64("class", F.lit(i))) for i in range(HEADS)]).alias("heads"))
        own = own.join(first, "root", "left").withColumn("head", F.coalesce(F.array_contains("heads", F.col("class")), F.lit(False)))
    own = own.select("root", "class", "rid", "blocks", "head")

    def texts_of(own):
        return own.join(sieved(docs.select(rid, "text"), own, "rid"), "rid").select("root", "class", "blocks", "head", "text")

    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("i")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    links = checkpoint(texts_of(own.filter("blocks = 1")).select("root", "class", "text").groupBy("root").applyInPandas(_link_texts(n, theta, table), "a long, b long"))
    if some_large:
        # read more than once; a map over rows, not a function of the text: that would be evaluated for all texts, below the join
        picked = checkpoint(texts_of(own.filter("blocks > 1")).mapInPandas(_sets(n, table), "root long, class long, blocks int, head boolean, grams binary"))
        dealt = picked.select("root", block, "class", "grams").unionByName(picked.filter("head").select("root", everywhere, "class", "grams"))
        links = links.unionByName(checkpoint(dealt.groupBy("root", "i").applyInPandas(_link_group(theta), "a long, b long")))
        # what is outside the largest component of its cluster meets every block of it
        roots = connected_components(links)
        labelled = checkpoint(large.select(F.col("root").alias("cluster"), "class", "n", "blocks").join(roots, F.col("class") == F.col("node"), "left").select("cluster", "class", "n", "blocks", F.coalesce("root", "class").alias("label")))
        most = labelled.groupBy("cluster", "label").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count("*").alias("labels"))
        open_ = labelled.join(most.filter("labels > 1"), "cluster")
        rest = open_.filter("label <> most").groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK_NGRAMS))).cast("int").alias("parts"))
        sets = picked.select(F.col("root").alias("cluster"), "class", "grams").join(open_.join(rest, "cluster"), ["cluster", "class"])
        part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
        there = sets.select("cluster", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "class", "label", "grams")
        here = sets.filter("label <> most").withColumn("j", part).select("cluster", everywhere, "j", "class", "label", "grams")
        links = links.unionByName(checkpoint(there.unionByName(here).groupBy("cluster", "i", "j").applyInPandas(_link_group(theta), "a long, b long")))
        roots = connected_components(links)
    else:  # roots within single-block clusters are final
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

    classes = some.join(roots, some["class"] == roots["node"], "left").select("class", "doc_id", "copies", F.coalesce("root", "class").alias("root"))
    first = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("members"))
    final = classes.join(first.filter("members > 1"), "root").select("class", "component_id")
    empty = keyed.filter("class is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = keyed.filter("class is not null").join(final, "class", "left").select("doc_id", "n", "component_id").unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _prefix_length(n: str, theta: int) -> str:
    return f"({n} - ({theta} * {n} + 99) div 100 + 1)"


def _surplus(n: str, theta: int) -> str:
    return f"least({_prefix_length(n, theta)} div 2, {n} - {_prefix_length(n, theta)})"


def _spare(n: str, theta: int) -> str:
    return _surplus(f"(({theta} * {n} + 99) div 100)", theta)


def _shared(prefixes: DataFrame) -> DataFrame:
    """Distinct prefix rows of the n-grams that two classes or more have there, with how many do; and ties. ``first``: others are tied to it."""
    rows = prefixes.repartition("gram").groupBy("gram", "class", "n", "band", "tie").agg(F.max("hot").alias("first"), F.max("held").alias("held"))
    of = W.partitionBy("gram")
    counted = rows.withColumn("df", F.count("*").over(of)).withColumn("hot", F.max("first").over(of))
    return counted.filter("df > 1 or hot or tie is not null")


def _rarest(shared: DataFrame, theta: int) -> DataFrame:
    """Without the ``spare`` most common rows of each class; those held back are hot, and count as such.

    Ties stay, and so do the rows that others are tied to.

    All classes rank an n-gram alike: by whether it is hot, the prefixes it is found in, and itself.
    """
    of = W.partitionBy("class", "is_tie")
    rows = shared.withColumn("is_tie", F.col("tie").isNotNull())
    rows = rows.withColumn("rank", F.row_number().over(of.orderBy("hot", "df", "gram"))).withColumn("rows", F.count("*").over(of)).withColumn("away", F.max("held").over(of))
    return rows.filter(F.col("is_tie") | F.col("first") | (F.col("rank") <= F.col("rows") + F.col("away") - F.expr(_spare("n", theta)))).select("gram", "class", "n", "band", "df", "hot", "tie")


def report(docs: DataFrame, n: int = 3, theta: int = 90) -> DataFrame:
    return components(docs, n, theta)


def keep_one(docs: DataFrame, n: int = 5, theta: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. Columns unchanged.

    Rows that repeat an id stay together or go together.
    """
    found = components(docs, n, theta)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
