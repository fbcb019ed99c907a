"""Secret scans: parts of multipart credentials are found apart and linked by an interval join within scopes."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base patterns (fixed values). Kinds in the order of their report; added kinds follow the base ones.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs, so that shorter ones fail alike
BASE_KINDS = ["assign", "access", "hex"]
ADDED_KINDS = ["endpoint", "keypart", "weak"]
KINDS = BASE_KINDS + ADDED_KINDS

#: Weak parts: a service address, a bare 40-character key, a short value in an assignment.
ENDPOINT = r"(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis)://[A-Za-z0-9._~:@%/?#&=+-]*[A-Za-z0-9/]"
HOST_END = ".amazonaws.com"
KEYPART = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("credential", T.LongType()),
    ]
)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def hosts(text: str) -> list[tuple[int, int]]:
    """Names of ``HOST_END``: dotted labels of a-z, 0-9 and hyphen before it. Sought from their ends, so that each character is seen once."""
    out: list[tuple[int, int]] = []
    floor, at = 0, text.find(HOST_END)
    while at >= 0:
        start = label = at  # walk back over whole labels
        joined = label == floor
        while label > floor:
            i = label - 1
            while i >= floor and (text[i] == "-" or "0" <= text[i] <= "9" or "a" <= text[i] <= "z"):
                i -= 1
            if i + 1 == label:
                break  # an empty label
            start = i + 1
            if i >= floor and text[i] != ".":
                break
            label = i
            joined = label <= floor
        end = at + len(HOST_END)
        if joined and out and floor == out[-1][1]:
            out[-1] = (out[-1][0], end)  # one name goes on
            floor = end
        elif start < at:
            out.append((start, end))
            floor = end
        at = text.find(HOST_END, at + 1 if floor < end else end)
    return out


def _link(parts: list[tuple[int, int, int]], scope: int) -> list[list[int]]:
    """Interval join of a text's sorted parts: the partners of each whose gap is at most ``scope``.

    Parts are kept apart by the power of two of their length, so that a long one does not widen the search for short ones.
    """
    classes: dict[int, tuple[list[int], list[int]]] = {}
    for j, (s, e, _) in enumerate(parts):
        starts, own = classes.setdefault((e - s).bit_length(), ([], []))
        starts.append(s)
        own.append(j)
    out = []
    for i, (s, e, _) in enumerate(parts):
        near = []
        for k, (starts, own) in classes.items():
            near += [j for j in own[bisect_left(starts, s - scope - (1 << k)) : bisect_left(starts, e + scope + 1)] if j != i and parts[j][1] >= s - scope]
        out.append(sorted(near))
    return out


def _scanner(scope: int, min_value: int, min_access: int, weak_value: int, min_entropy: float):
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    access, hexes, endpoint, keypart = map(re.compile, (ACCESS, HEX, ENDPOINT, KEYPART))

    def scan(text) -> list[tuple]:
        if not isinstance(text, str) or not text:
            return []
        base, weak = [], []
        for m in assign.finditer(text):
            n = m.end(2) - m.start(2)
            (base if n >= min_value else weak).append((m.start(), m.end(), KINDS.index("assign" if n >= min_value else "weak"), n))
        weak = [x[:3] for x in weak if x[3] >= weak_value]
        base = [x[:3] for x in base]
        base += [(m.start(), m.end(), 1) for m in access.finditer(text) if m.end() - m.start() >= min_access]
        base += [(m.start(), m.end(), 2) for m in hexes.finditer(text)]
        urls = [m.span() for m in endpoint.finditer(text)]
        ends = [e for _, e in urls]
        weak += [(s, e, 3) for s, e in urls]
        weak += [(s, e, 3) for s, e in hosts(text) if (at := bisect_left(ends, s + 1)) == len(urls) or urls[at][0] >= e]
        weak += [(m.start(), m.end(), 4) for m in keypart.finditer(text) if _entropy(m[0]) >= min_entropy]
        parts = sorted(base + weak)
        # identifiers, secrets and addresses complement one another
        role = {0: "secret", 1: "identifier", 2: "secret", 3: "address", 4: "secret", 5: "secret"}
        near = _link(parts, scope) if len(parts) > 1 else [[]]
        out, credential = [], {}
        for i, (s, e, k) in enumerate(parts):
            partners = [j for j in near[i] if role[parts[j][2]] != role[k] and not (parts[j][0] < e and s < parts[j][1])]
            if k < len(BASE_KINDS) or partners:
                anchor = min([i, *partners])
                credential[i] = credential.get(anchor, anchor)
                out.append((s, k, e, credential[i] if partners else None))
        return [(KINDS[k], s, e, c) for s, k, e, c in sorted(out, key=lambda x: x[:3])]

    return scan


def find(docs: DataFrame, scope: int = 200, min_value: int = 12, min_access: int = 18, weak_value: int = 6, min_entropy: float = 3.5, into: str = "secrets") -> DataFrame:
    """``docs`` with an array of the secrets in each whole text: kind, start, end (code points, end exclusive), credential.

    Base kinds stand alone: ``assign`` (a value of ``min_value`` characters or more given to a telling
    name), ``access`` (an access identifier) and ``hex`` (a long lowercase hexadecimal run). Weak parts
    (an ``endpoint``, a bare ``keypart`` of high entropy, a ``weak`` short value) are reported only where
    a part of another role (identifier, secret, address) lies within ``scope`` code points of the same
    text. ``credential`` joins the parts that go together; it is null where a part stands alone.

    Null or empty texts: no spans. Spans that start together are ordered by kind, as listed. Texts are
    scanned whole, row by row; equal rows give equal results; all other columns stay.
    """
    scan = _scanner(scope, min_value, min_access, weak_value, min_entropy)

    def run(batches):
        for texts in batches:
            yield pd.Series([scan(t) for t in texts], dtype=object)

    spans = F.pandas_udf(run, T.ArrayType(SPAN), F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(into, spans(F.col("text").cast("string")))


def span_text(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def report(docs: DataFrame, **params) -> DataFrame:
    found = find(docs.select("doc_id", "text"), **params, into="spans_found")
    spans = F.col("spans_found")
    count = lambda kind: F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(F.filter(spans, lambda x: x.kind.isin(BASE_KINDS))), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: x.credential.isNotNull())).cast("long").alias("n_linked"),
    )
