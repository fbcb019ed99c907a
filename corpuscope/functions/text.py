"""Column functions over code and prose: tokens, terms, markers, lines."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal of their own.
PROSE_STOP = "a an and are as at be by for from in into is it of on or that the then this through to with".split()
GRAPH_STOP = "and arg args bool case class ctx data dict else err error false file func int kwargs list none null object return self str string true type".split()
LEAK_STOP = (
    "the and for with from into this that get set new old src lib test tests util utils core common base main init impl type types data value values "
    "key keys name names file files func method class module package"
).split()
CALL_STOP = "call caller calls current site sites usage use used where".split()
TERM_SUFFIXES = ["ing", "ers", "er", "ments", "ment", "es", "s"]
GENERATED_MARKERS = [
    "@generated", "generated by", "generated using", "generated from", "generated automatically", "automatically generated",
    "autogenerated", "auto-generated", "code generated",
]
DO_NOT_EDIT = r"do\s*n[o']?t\s+(?:\w+\s+){0,2}(?:edit|modify|change)"
STRUCTURAL = [
    r"\bwho\s+calls\b", r"\b(callers?|callees?)\b", r"\b(call\s+graph|dependency|dependencies)\b", r"\b(impact|blast\s+radius|reachable|references?)\b",
    r"\b(definitions?|usages?)\s+of\b", r"\b(inherits?|subclasses?|overrides?)\b", r"\b(data\s+flow|control\s+flow)\b",
]
LEXICAL = [
    r"`[^`]+`", r"\b[A-Za-z_][A-Za-z0-9_]*\([^)]*\)", r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*::[A-Za-z_][A-Za-z0-9_]*\b", r"\b[A-Za-z]+_[A-Za-z0-9_]+\b",
    r"\b[A-Z][A-Za-z0-9]*(Error|Exception|Factory|Manager|Service)\b", r"[\w./-]+\.(py|js|ts|go|rs|java|cpp|c|h|hpp|rb|php|kt|scala)\b",
]
SEMANTIC = r"\b(how|why|what|when|where|explain|behavior|logic|flow|handle|support)\b"


def code_tokens(text: Column) -> Column:
    """Alphanumeric runs in lower case, empty call brackets removed first."""
    bare = F.replace(F.coalesce(text, F.lit("")), F.lit("()"), F.lit(""))
    # A-Z alone become lower case, so that no other letter turns into one of these; two ranges match much faster than three
    low = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, "[^a-z0-9]+", -1), "")


def focus_terms(query: Column, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(stop))))


def subword_terms(text: Column) -> Column:
    """Camel and snake pieces of identifiers of 3 letters or more, and the same without a common suffix."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(words, lambda w: F.split(w, "_+", -1))), lambda x: x != "")
    camel = "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"

    def pieces(part):
        found = F.regexp_extract_all(part, F.lit(camel), F.lit(0))
        return F.when(F.size(found) > 0, found).otherwise(F.array(part))

    low = F.transform(F.flatten(F.transform(parts, pieces)), F.lower)
    low = F.filter(low, lambda x: (F.length(x) >= 3) & ~x.isin(GRAPH_STOP))

    def stems(x):
        cut = [F.when((F.length(x) > len(s) + 2) & x.endswith(s), F.substring(x, F.lit(1), F.length(x) - len(s))) for s in TERM_SUFFIXES]
        return F.filter(F.array(x, *cut), lambda y: y.isNotNull())

    return F.array_sort(F.array_distinct(F.flatten(F.transform(low, stems))))


def leak_tokens(symbol: Column) -> Column:
    """Distinctive pieces of an identifier or path."""
    chunks = F.split(F.coalesce(symbol, F.lit("")), r"[./:\\#()_-]+", -1)
    pieces = F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(c, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))))
    return F.array_distinct(F.filter(F.transform(pieces, F.lower), lambda x: (F.length(x) > 1) & ~x.isin(LEAK_STOP)))


def query_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), F.lower))


def prose_terms(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[`*_\[\]()#>/-]", " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) > 1) & ~x.isin(PROSE_STOP)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared terms over those of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def query_signals(text: Column) -> tuple[Column, Column, Column]:
    """(lexical, semantic, structural) evidence in a query."""
    t = F.coalesce(text, F.lit(""))
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    structural = t.rlike("(?i)" + "|".join(f"(?:{p})" for p in STRUCTURAL))
    lexical = t.rlike("|".join(f"(?:{p})" for p in LEXICAL))
    semantic = t.rlike("(?i)" + SEMANTIC) | (words >= 10)
    return lexical | (~semantic & (words > 0) & (words <= 4)), semantic, structural


def query_identifiers(text: Column, limit: int = 4) -> Column:
    """Names that a query spells like code: in backticks, with an underscore or hump, or all capitals."""
    t = F.coalesce(text, F.lit(""))
    noise = ["BUG", "TODO", "FIXME", "NOTE", "XXX", "HACK", "WARNING", "ERROR"]
    ticked = F.transform(F.regexp_extract_all(t, F.lit("`([^`\n]{2,60})`"), F.lit(1)), F.trim)
    plain = F.filter(F.regexp_extract_all(t, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), lambda x: x.rlike("_|[a-z][A-Z]") | ((F.upper(x) == x) & x.rlike("[A-Z]")))
    return F.slice(F.array_distinct(F.filter(F.concat(ticked, plain), lambda x: ~x.isin(noise))), 1, limit)


def has_generated_marker(text: Column, banner: int = 5) -> Column:
    """A generation banner among the first comment lines of a file (line comments and one opening block)."""
    head = F.slice(F.split(F.coalesce(text, F.lit("")), "\n", -1), 1, 60)
    kept = F.filter(F.transform(head, F.trim), lambda x: x != "")

    def step(acc, line):
        comment = line.rlike(r"^(?:#|//|\*|--|;|%|/\*|<!--|\"\"\"|''')") | acc["open"]
        opens = (line.rlike(r"^/\*") & ~line.contains("*/")) | (line.rlike("^<!--") & ~line.contains("-->"))
        closes = line.contains("*/") | line.contains("-->")
        on = acc["on"] & comment
        return F.struct(on.alias("on"), (on & (opens | (acc["open"] & ~closes))).alias("open"), F.when(on, F.concat(acc["lines"], F.array(F.lower(line)))).otherwise(acc["lines"]).alias("lines"))

    start = F.struct(F.lit(True).alias("on"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("lines"))
    top = F.array_join(F.slice(F.aggregate(kept, start, step, lambda acc: acc["lines"]), 1, banner), "\n")
    marks = "|".join(re.escape(m) for m in GENERATED_MARKERS)
    return top.rlike(marks) | top.rlike(DO_NOT_EDIT)


def lines_between(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 0, both included, clamped to the text."""
    lines = F.split(text, "\n", -1)
    first = F.greatest(start, F.lit(0))
    return F.array_join(F.slice(lines, first + 1, F.greatest(F.least(end, F.size(lines) - 1) - first + 1, F.lit(0))), "\n")


def elide_middle(text: Column, limit: int, mark: str = " ... ") -> Column:
    """A text of at most ``limit`` characters: its beginning and end around a mark."""
    keep = limit - len(mark)
    head = (keep + 1) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, F.length(text) - (keep - head) + 1, F.lit(keep - head))))


def content_id(prefix: str, *columns: str) -> Column:
    """A stable id of a record: SHA-256 of its canonical JSON (keys in order)."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
