"""Column predicates and helpers over repository paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, suffixes and stems that the classifications are defined by.
TEST_PARTS = ["test", "tests", "testing", "spec", "specs", "__tests__"]
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs"]
TEST_ENDINGS = ["_test.py", "_test.js", "_test.ts", "_spec.py", "_spec.js", "_spec.ts"]
NON_SOURCE_DIRS = ["dist", "build", "out", "node_modules", "vendor"]
NON_SOURCE_SUFFIXES = [".min.js", ".d.ts", ".d.cts", ".d.mts", ".map", ".snap"]
DECLARATION_SUFFIXES = [".d.ts", ".d.cts", ".d.mts", ".pyi", ".pxd"]
SOURCE_EXTENSIONS = "py pyx go rs ts tsx js jsx mjs cjs mts cts c h cc cpp hpp cxx java rb php cs kt kts swift scala lua m mm".split()
IGNORED_DIRS = ["node_modules", "__pycache__", "venv", "env", "build", "dist", "target", "vendor"]


def _any(words) -> str:
    return "|".join(re.escape(w) for w in words)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_part(node: Column) -> Column:
    """The file of ``file:symbol``, normalised and in lower case."""
    return F.lower(posix(F.substring_index(node, ":", 1)))


def is_test_path(path: Column) -> Column:
    """Any test directory or file name, or a test-like stem (rule set A). Null and empty paths are not tests."""
    p, low = posix(path), F.lower(posix(path))
    rules = rf"(?:^|/)(?:{_any(TEST_PARTS)})(?:/|$)|(?:^|/)test_[^/]*$|[._-](?:test|spec)\.[^/]*$|(?:_tests?|-tests?|[_-]spec)(?:\.[^./]*)?/*$|\.(?:test|spec)\.[^/]*/*$"
    return F.coalesce(low.rlike(rules) | p.rlike(r"(?:Tests?|Spec)(?:\.[^./]*)?$"), F.lit(False))


def is_test_file(node: Column) -> Column:
    """Test directories above the file, or a test-like file name (rule set B)."""
    rules = rf"(?:^|/)(?:{_any(TEST_DIRS)})/+[^/]|(?:^|/)test[^/]*/*$|(?:{_any(TEST_ENDINGS)})/*$|\.(?:test|spec)\.[^/]*/*$"
    return F.coalesce(file_part(node).rlike(rules), F.lit(False))


def is_non_source_file(node: Column) -> Column:
    rules = rf"(?:^|/)(?:{_any(NON_SOURCE_DIRS)})/+[^/]|(?:{_any(NON_SOURCE_SUFFIXES)})/*$"
    return F.coalesce(file_part(node).rlike(rules), F.lit(False))


def is_source_file(node: Column) -> Column:
    return F.coalesce(file_part(node).rlike(rf"\.(?:{_any(SOURCE_EXTENSIONS)})$"), F.lit(False))


def is_declaration_file(node: Column) -> Column:
    return F.coalesce(file_part(node).rlike(rf"(?:{_any(DECLARATION_SUFFIXES)})/*$"), F.lit(False))


def extension(path: Column) -> Column:
    """The last suffix of the file name, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(posix(path), r"[^/.][^/]*(\.[^./]+)$", 1))


def include_extensions(path: Column, extensions: list[str]) -> Column:
    allowed = sorted({e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions if e})
    return F.coalesce(extension(path).isin(allowed), F.lit(False)) if allowed else F.lit(True)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole string; ``*`` crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            body = pattern[i:j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j + 1
        else:
            out += re.escape(c)
    return f"(?s)^(?:{out})$"


def matches_glob(path: Column, pattern: str) -> Column:
    return posix(path).rlike(glob_to_regex(pattern))


def exclude_paths(path: Column, patterns: list[str]) -> Column:
    """True where no pattern matches; null and empty paths pass."""
    keep = F.lit(True)
    for p in filter(None, patterns):
        keep = keep & ~F.coalesce(matches_glob(path, p), F.lit(False))
    return keep | (F.coalesce(path, F.lit("")) == "")


def is_visible(path: Column) -> Column:
    """No hidden or ignored directory on the way."""
    return ~F.coalesce(posix(path).rlike(rf"(?:^|/)(?:\.[^/]+|{_any(IGNORED_DIRS)})/"), F.lit(False))


def source_filter(path: Column, content: Column, extensions: list[str], ignore: list[str], max_bytes: int = 10 * 1024 * 1024, max_line: int = 10_000) -> Column:
    """Files worth chunking: an allowed suffix, not ignored, not a test, not too large, no line over ``max_line``."""
    name = F.substring_index(posix(path), "/", -1)
    ok = F.concat(F.lit("."), F.substring_index(name, ".", -1)).isin(extensions) & name.contains(".")
    for p in ignore:
        ok = ok & ~(name.endswith(p[1:]) if p.startswith("*") else name.startswith(p[:-1]) if p.endswith("*") else name == p)
    lines = F.split(content, "\n", -1)
    return ok & ~is_test_file(path) & (F.octet_length(content) <= max_bytes) & ~F.exists(lines, lambda x: F.length(x) > max_line)


def normalize(path: Column) -> Column:
    """Canonical relative path: no empty, ``.`` or ``..`` parts; null if absolute, with a drive or NUL, or escaping."""
    parts = F.split(posix(path), "/", -1)
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) == 0, F.lit(None)).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))
    )
    out = F.aggregate(parts, F.array().cast("array<string>"), step)
    bad = path.startswith("/") | posix(path).rlike(r"^[A-Za-z]:|^/") | path.contains("\x00")
    return F.when(~bad & (F.size(out) > 0), F.array_join(out, "/"))


def normalize_symbol(symbol: Column) -> Column:
    """``path:Symbol`` with a canonical path; null for a drive or a path that escapes; names without a path stay."""
    file = normalize(F.substring_index(symbol, ":", 1))
    rest = F.substring(symbol, F.instr(symbol, ":"), F.length(symbol))
    own = F.when(file.isNotNull(), F.concat(file, rest))
    return F.when(symbol.rlike("^[A-Za-z]:") | (symbol == ""), F.lit(None)).when(symbol.contains(":"), own).otherwise(symbol)
