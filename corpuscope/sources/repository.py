"""Repository sources and sinks: files, chunks, diffs, datasets, occurrences, content-addressed payloads."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import paths
from corpuscope.sources import braces

CHUNK_SCHEMA = "node_id string, file string, name string, chunk_type string, start_line int, end_line int, content string, content_hash string"

# Language of a file by its suffix.
LANGUAGES = {
    "py": "python", "pyx": "python", "go": "go", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "java": "java", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "swift": "swift", "scala": "scala", "lua": "lua",
    "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cxx": "cpp",
}

def discover(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(file, language, content) of visible source files below a folder, by relative path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = raw.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), F.col("content").cast("string").alias("content"))
    own = base.select(F.regexp_replace("path", "^" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "").alias("file"), "content")
    known = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)])
    own = own.withColumn("language", known[F.substring(paths.extension(F.col("file")), 2, 20)])
    own = own.filter(F.col("language").isNotNull() & paths.is_visible(F.col("file")))
    return own.filter(F.col("language").isin(languages)) if languages else own


def definitions(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, qualified name, first line, last line) of the definitions of a file."""
    if language == "python":
        out = []

        def visit(body, prefix):
            for node in body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(node, ast.ClassDef) else "method" if prefix else "function"
                    first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                    out.append((kind, prefix + node.name, first - 1, node.end_lineno - 1))
                    if isinstance(node, ast.ClassDef):
                        visit(node.body, f"{prefix}{node.name}.")

        visit(ast.parse(text).body, "")
        return out
    return braces.definitions(text, language) if language in braces.HEADERS else []


def chunk(files: DataFrame, strict: bool = False) -> DataFrame:
    """Chunks of files (file, language, content); a file that does not parse raises if ``strict``, else is one chunk."""

    def run(batches):
        import hashlib

        for pdf in batches:
            out = []
            for file, language, text in zip(pdf["file"], pdf["language"], pdf["content"]):
                text = text or ""
                try:
                    found = definitions(text, language)
                except (SyntaxError, ValueError, RecursionError):
                    if strict:
                        raise
                    found = []
                lines = text.split("\n")
                for kind, name, s, e in found or [("file", file, 0, len(lines) - 1)]:
                    body = "\n".join(lines[s : e + 1])
                    call = "()" if kind in ("function", "method") else ""
                    out.append((f"{file}:{name}{call}" if kind != "file" else file, file, name, kind, s, e, body, hashlib.md5(body.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return files.select("file", "language", "content").mapInPandas(run, CHUNK_SCHEMA)


def with_prefix(chunks: DataFrame) -> DataFrame:
    """Content with its id, and its class where it is a method."""
    owner = F.regexp_extract("name", r"^(.*)\.[^.]+$", 1)
    return chunks.withColumn("content", F.concat_ws("\n", "node_id", F.when((F.col("chunk_type") == "method") & (owner != ""), F.concat(F.lit("class "), owner, F.lit(":"))), "content"))


def git_status(spark: SparkSession, path: str) -> DataFrame:
    """(commit, status, path, old_path) from tab-separated change lists."""
    return spark.read.schema("commit string, status string, path string, old_path string").option("sep", "\t").csv(path)


def load_cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cells from JSON files; usable ones only."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).filter("success is not null and metrics_meaningful")


def load_dataset(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """A benchmark dataset with a fixed schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", "true").csv(path) if kind == "csv" else getattr(reader, kind)(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_view(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def fingerprint(files: DataFrame, group: str | None = None) -> DataFrame:
    """SHA-256 over (path, hash) of all files in path order."""
    line = F.struct("file", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: F.concat_ws(":", x["file"], x["h"])), "\n")
    out = F.sha2(joined, 256).alias("fingerprint")
    return files.groupBy(group).agg(out) if group else files.agg(out)


def put_payloads(df: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Content-addressed store: distinct payloads by SHA-256, sharded by its first two digits."""
    own = df.select(F.sha2(content, 256).alias("sha"), content).dropDuplicates(["sha"]).withColumn("shard", F.substring("sha", 1, 2))
    own.write.mode("ignore").partitionBy("shard").parquet(path)
    return own.select("sha")


def parse_occurrences(rows: DataFrame) -> DataFrame:
    """Text occurrences ``l:c-c symbol roles`` or ``l:c-l:c symbol roles`` as (file, span, symbol, roles)."""
    pat = r"^(\d+):(\d+)-(?:(\d+):)?(\d+) (.+) (\d+)$"
    part = lambda i: F.regexp_extract("line", pat, i)
    own = rows.filter(F.col("line").rlike(pat))
    start = part(1).cast("int")
    return own.select("file", start.alias("start_line"), part(2).cast("int").alias("start_char"), F.when(part(3) == "", start).otherwise(part(3).cast("int")).alias("end_line"), part(4).cast("int").alias("end_char"), part(5).alias("symbol"), part(6).cast("int").alias("roles"))


def hydrate(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Missing contents from the files' lines; those present stay."""
    from corpuscope.functions.text import lines_between

    own = candidates.join(files.select("file", F.col("content").alias("__text")), "file", "left")
    return own.withColumn("content", F.coalesce("content", lines_between(F.col("__text"), F.col("start_line"), F.col("end_line")))).drop("__text")
