"""Code-intelligence indexes: the public SCIP protobuf format and nested editor symbols, decoded to vertices, edges and occurrences."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCCURRENCES = "file string, start_line int, start_char int, end_line int, end_char int, symbol string, roles int"
SYMBOLS = "file string, symbol string, display_name string, kind int, enclosing_symbol string, relations array<struct<symbol:string,kind:string>>"

# Field numbers of the format's messages, bits of an occurrence's roles, names of relationship fields.
INDEX_DOCUMENTS, DOCUMENT_PATH, DOCUMENT_OCCURRENCES, DOCUMENT_SYMBOLS = 2, 1, 2, 3
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES = 1, 2, 3
SYMBOL_NAME, SYMBOL_RELATIONS, SYMBOL_KIND, SYMBOL_DISPLAY, SYMBOL_ENCLOSING = 1, 4, 5, 6, 8
RELATIONS = {2: "reference", 3: "implementation", 4: "type_definition", 5: "definition"}
DEFINITION_ROLE = 1


def _varint(buf, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(buf):
    """(field number, value) of a protobuf message: whole numbers, or byte views of what has a length."""
    at, end = 0, len(buf)
    while at < end:
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            size, at = _varint(buf, at)
            if at + size > end:
                raise ValueError("a field reaches beyond its message")
            value, at = buf[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = buf[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def _numbers(value) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def _text(value) -> str:
    return bytes(value).decode("utf-8", "replace")


def decode_document(buf) -> tuple[list[tuple], list[tuple]]:
    """Occurrence and symbol rows of one document. Ranges of three numbers end on the line they begin on."""
    path, occurrences, symbols = "", [], []
    for number, value in fields(buf):
        if number == DOCUMENT_PATH:
            path = _text(value)
        elif number == DOCUMENT_OCCURRENCES:
            span, symbol, roles = [], "", 0
            for k, v in fields(value):
                if k == OCCURRENCE_RANGE:
                    span += _numbers(v)
                elif k == OCCURRENCE_SYMBOL:
                    symbol = _text(v)
                elif k == OCCURRENCE_ROLES:
                    roles = v
            if len(span) in (3, 4) and symbol:
                occurrences.append((span[0], span[1], *((span[0], span[2]) if len(span) == 3 else span[2:]), symbol, roles))
        elif number == DOCUMENT_SYMBOLS:
            name = display = enclosing = None
            kind, relations = 0, []
            for k, v in fields(value):
                if k == SYMBOL_NAME:
                    name = _text(v)
                elif k == SYMBOL_KIND:
                    kind = v
                elif k == SYMBOL_DISPLAY:
                    display = _text(v)
                elif k == SYMBOL_ENCLOSING:
                    enclosing = _text(v)
                elif k == SYMBOL_RELATIONS:
                    own = dict(fields(v))
                    relations += [(_text(own.get(1, b"")), kind_) for f, kind_ in RELATIONS.items() if own.get(f)]
            if name:
                symbols.append((name, display, kind, enclosing, relations))
    return [(path, *x) for x in occurrences], [(path, *x) for x in symbols]


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, symbols) of all index files below a path. A file is one task's work; a document is decoded at a time."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.scip").load(path).select("content")

    def run(part, schema):
        names = [x.split()[0] for x in schema.split(", ")]

        def decode(batches):
            for pdf in batches:
                for content in pdf["content"]:
                    rows = []
                    for number, value in fields(memoryview(content)):
                        if number == INDEX_DOCUMENTS:
                            rows += decode_document(value)[part]
                            if len(rows) > 20_000:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                    yield pd.DataFrame(rows, columns=names)

        return decode

    return raw.mapInPandas(run(0, OCCURRENCES), OCCURRENCES), raw.mapInPandas(run(1, SYMBOLS), SYMBOLS)


def scoped(symbol, file):
    """A symbol's key: those called ``local ...`` belong to their file."""
    return F.when(F.col(symbol).startswith("local "), F.concat_ws("#", F.col(file), F.col(symbol))).otherwise(F.col(symbol))


def index_graph(occurrences: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) by name: files and defined symbols; containment, references anchored where they occur, and relations.

    A reference goes out from the innermost symbol defined before it on its file, by line; without any, from the file.
    """
    from pyspark.sql import Window as W

    occ = occurrences.withColumn("name", scoped("symbol", "file")).withColumn("defines", F.col("roles").bitwiseAND(DEFINITION_ROLE) == DEFINITION_ROLE)
    defs = occ.filter("defines").groupBy("name").agg(F.min(F.struct("file", "start_line", "end_line")).alias("at"))
    shown = symbols.withColumn("name", scoped("symbol", "file")).groupBy("name").agg(F.max("kind").alias("symbol_kind"), F.max("display_name").alias("display_name"))
    own = defs.join(shown, "name", "left").select("name", F.lit("symbol").alias("type"), F.col("at.file").alias("file"), F.col("at.start_line").alias("start_line"), F.col("at.end_line").alias("end_line"), "symbol_kind", "display_name")
    paths = occ.select("file").union(symbols.select("file")).distinct()
    whole = paths.select(F.col("file").alias("name"), F.lit("file").alias("type"), "file", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("int").alias("symbol_kind"), F.lit(None).cast("string").alias("display_name"))
    vertices = whole.unionByName(own)
    before = W.partitionBy("file").orderBy("start_line", "start_char", F.desc("defines"), "name").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = occ.withColumn("owner", F.coalesce(F.last(F.when(F.col("defines") & ~F.col("symbol").startswith("local "), F.col("name")), ignorenulls=True).over(before), F.col("file")))
    known = defs.select("name")
    refs = placed.filter("not defines and owner <> name").join(known, "name", "left_semi")
    null = F.lit(None)
    edges = refs.select(F.col("owner").alias("src"), F.col("name").alias("dst"), F.lit("reference").alias("type"), F.col("file").alias("anchor_file"), F.col("start_line").alias("anchor_line"))
    enclosed = symbols.filter(F.coalesce("enclosing_symbol", F.lit("")) != "").select(scoped("symbol", "file").alias("name"), scoped("enclosing_symbol", "file").alias("parent"))
    contain = own.join(enclosed, "name", "left").select(F.coalesce("parent", "file").alias("src"), F.col("name").alias("dst"), F.lit("contain").alias("type"), null.cast("string").alias("anchor_file"), null.cast("int").alias("anchor_line"))
    related = symbols.select(scoped("symbol", "file").alias("src"), F.explode("relations").alias("r")).select("src", F.col("r.symbol").alias("dst"), F.col("r.kind").alias("type"), null.cast("string").alias("anchor_file"), null.cast("int").alias("anchor_line"))
    return vertices, edges.unionByName(contain).unionByName(related.filter("type <> 'reference' or src <> dst")).distinct()


SYMBOL_TREE = "file string, name string, kind int, start_line int, end_line int, parent string, depth int"


def flatten_symbols(rows: DataFrame) -> DataFrame:
    """Nested editor symbols (file, symbols: JSON of name, kind, range and children) as one row each, with qualified names."""
    names = [x.split()[0] for x in SYMBOL_TREE.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for file, tree in zip(pdf["file"], pdf["symbols"]):
                todo = [(x, None, 0) for x in reversed(json.loads(tree or "[]"))]
                while todo:
                    node, parent, depth = todo.pop()
                    span = node.get("range") or (node.get("location") or {}).get("range") or {}
                    name = f"{parent}.{node['name']}" if parent else node["name"]
                    out.append((file, name, node.get("kind"), span.get("start", {}).get("line"), span.get("end", {}).get("line"), parent, depth))
                    todo += [(x, name, depth + 1) for x in reversed(node.get("children") or [])]
            yield pd.DataFrame(out, columns=names).astype({"kind": "Int32", "start_line": "Int32", "end_line": "Int32", "depth": "int32"})

    return rows.select("file", "symbols").mapInPandas(run, SYMBOL_TREE)
