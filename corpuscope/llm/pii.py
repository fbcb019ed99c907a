"""PII: boosted trees choose among the spans that high-recall generators propose. DataFrame functions alone.

Base kinds (email, ip, card, phone) are checked by format and always stay. Further generators propose
overlapping candidates without a check digit or fixed format; gradient-boosted trees over format and
context features score them, and a threshold calibrated for each kind selects redactions. The trees are
SQL expressions, so texts never leave the JVM.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base patterns. They match what the plain forms in the comments do; possessive loops and look-behinds
#: only keep Java's matcher from recursion and from trying the inside of a failed run again.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = list(BASE)

#: High-recall generators.
GENERATORS = {
    "local_phone": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,40}\x20?[\[(]?\x20?(?:at|AT)\x20?[\])]?\x20?[A-Za-z0-9-]{1,40}\x20?[\[(]?\x20?(?:dot|DOT)\x20?[\])]?\x20?[a-z]{2,6}(?![A-Za-z0-9])",
    "birth_date": r"(?<![0-9])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9])",
}
KINDS = BASE_KINDS + list(GENERATORS)

#: Characters of context on either side of a candidate; words that tell.
CONTEXT = 40
CUES = {
    "cue_phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact|reach)",
    "cue_id": r"(?i)\b(?:ssn|social|national|passport|insurance|id)\b",
    "cue_bank": r"(?i)\b(?:iban|account|bank|transfer|payee)",
    "cue_mail": r"(?i)\b(?:mail|email|write|contact|reach|address)",
    "cue_birth": r"(?i)\b(?:born|birth|birthday|dob)",
    "cue_goods": r"(?i)\b(?:order|part|item|version|release|invoice|serial|model|isbn|sku|batch|page|updated|issued|due)",
}
FEATURES = ["length", "digits", "letters", "marks", "brackets", "before_space", "after_word", *CUES, *[f"is_{k}" for k in GENERATORS]]


#: Elements that are scanned one after the other; a longer array is scanned block by block, so that copies stay short.
BLOCK = 256
#: Code points of the longest candidate, or of a piece of a base span when the two are compared, and a bound on
#: how many of these begin within so many code points (the shortest matches of all kinds, end to end).
REACH = 128
NEIGHBOURS = 200


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op, zero: Column) -> Column:
    """What ``op`` makes of all values before each element, for an associative ``op``."""

    def scanned(items, element):
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(op(acc["at"], element(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda j: scanned(F.slice(v, j * BLOCK + 1, BLOCK), lambda x: x))
        return let(blocks, lambda d: F.flatten(F.zip_with(d, scanned(d, lambda x: x["at"])["out"], lambda x, o: F.transform(x["out"], lambda y: op(o, y)))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, needs: str | None = None, context: int = 0) -> Column:
    """Array of (s, m): the leftmost non-overlapping matches of a text and their starts in code points.

    With ``context``, also so many characters before and after. The work grows with the text's length alone.
    """
    kind = "s:int,m:string" + (",before:string,after:string" if context else "")
    none = F.array().cast(f"array<struct<{kind}>>")

    def around(z, x, i):
        """What stands beside match i, from the pieces and matches next to it."""
        few = context // 4 + 1
        before = F.slice(z, F.greatest(i + 1 - few, F.lit(1)), F.least(i, F.lit(few)))
        before = F.concat(F.array_join(F.transform(before, lambda y: F.concat(F.right(y["p"], F.lit(context)), y["m"])), ""), F.right(x["p"], F.lit(context)))
        after = F.array_join(F.transform(F.slice(z, i + 2, few), lambda y: F.concat(F.left(y["p"], F.lit(context)), F.coalesce(y["m"], F.lit("")))), "")
        return [F.right(before, F.lit(context)).alias("before"), F.left(after, F.lit(context)).alias("after")]

    def placed(z):
        # the last piece, after the last match, has no partner
        starts = running(F.transform(z, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b, F.lit(0))
        each = lambda x, i: F.struct((F.get(starts_of, i) + F.length(x["p"])).alias("s"), x["m"].alias("m"), *(around(z, x, i) if context else []))

        def use(own):
            nonlocal starts_of
            starts_of = own
            return F.filter(F.transform(z, each), lambda x: x["m"].isNotNull())

        starts_of = None
        return let(starts, use)

    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    some = let(F.arrays_zip(pieces.alias("p"), found.alias("m")), placed)
    return F.when(F.contains(text, F.lit(needs)) if needs else text.rlike(pattern), some).otherwise(none)


def _luhn(match: Column) -> Column:
    d = F.reverse(F.split(F.regexp_replace(match, "[^0-9]", ""), ""))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, (x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))).otherwise(x.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def _holds(kind: str, m: Column) -> Column:
    n = _digits(m)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(m)).otherwise(False)
    return (n >= 9) & (n <= 15)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (with text ``t``) with an array of candidates for each generator, context and features included."""
    t = F.col("t")
    out = docs
    for kind, pattern in GENERATORS.items():
        out = out.withColumn(f"g_{kind}", spans(t, pattern, context=CONTEXT))

    def features_of(kind):
        def featured(x):
            m, s, before = x["m"], x["s"], x["before"]
            e = s + F.length(m)
            after = F.left(x["after"], F.lit(1))
            around = F.concat(before, F.lit(" "), x["after"])
            num = lambda c: c.cast("double")
            return F.struct(
                F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), m.alias("m"),
                num(F.length(m)).alias("length"), num(_digits(m)).alias("digits"), num(F.length(F.regexp_replace(m, "[^A-Za-z]", ""))).alias("letters"),
                num(F.length(F.regexp_replace(m, r"[^-.\x20/]", ""))).alias("marks"), num(m.rlike(r"[\[(]")).alias("brackets"),
                num(before.rlike(r"\s$")).alias("before_space"), num(after.rlike("[A-Za-z0-9]")).alias("after_word"),
                *[num((around if c in ("cue_mail",) else before).rlike(p)).alias(c) for c, p in CUES.items()],
                *[num(F.lit(kind == k)).alias(f"is_{k}") for k in GENERATORS],
            )

        return featured

    every = [F.transform(F.col(f"g_{kind}"), features_of(kind)) for kind in GENERATORS]
    return out.withColumn("candidates", F.concat(*every)).drop(*[f"g_{k}" for k in GENERATORS])


class BoostedTrees:
    """Depth-two regression trees on the logistic loss."""

    def __init__(self, rounds: int = 24, rate: float = 0.4):
        self.rounds, self.rate, self.trees, self.base = rounds, rate, [], 0.0
        self.thresholds: dict[str, float] = {}

    def _stump(self, x, g, h):
        best = (0.0, 0, 0.5)
        total = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(cut) + 0.5)
        return best[1:]

    def fit(self, x: np.ndarray, y: np.ndarray):
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(math.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            f, cut = self._stump(x, g, h)
            tree, side = [f, cut], x[:, f] <= cut
            for own in (side, ~side):
                f2, cut2 = self._stump(x[own], g[own], h[own]) if own.sum() > 1 else (0, 0.5)
                values = []
                for leaf in (own & (x[:, f2] <= cut2), own & (x[:, f2] > cut2)):
                    v = self.rate * float(g[leaf].sum() / (h[leaf].sum() + 1))
                    z[leaf] += v
                    values.append(round(v, 6))
                tree.append((f2, cut2, *values))
            self.trees.append(tree)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, cut, low, high in self.trees:
            for own, (f2, cut2, a, b) in ((x[:, f] <= cut, low), (x[:, f] > cut, high)):
                z += np.where(own, np.where(x[:, f2] <= cut2, a, b), 0)
        return z

    def expression(self, c: Column) -> Column:
        def leafs(t):
            f, cut, a, b = t
            return F.when(c[FEATURES[f]] <= cut, a).otherwise(b)

        z = F.lit(self.base)
        for f, cut, low, high in self.trees:
            z = z + F.when(c[FEATURES[f]] <= cut, leafs(low)).otherwise(leafs(high))
        return z


def _labelled(n: int, seed: int):
    """Invented sentences with a candidate each: (text, true value or empty)."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    names = ["jane.doe", "m.weber", "lucia", "p_martin", "omar77"]
    out = []
    for _ in range(n):
        sep = r.choice("- .")
        phone = r.choice([f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"({num(3)}) {num(3)}-{num(4)}"])
        ident, iban = f"{num(3)}-{num(2)}-{num(4)}", r.choice(["DE", "FR", "ES", "GB"]) + num(2) + num(r.choice([14, 18, 20]))
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " dot ")])
        mail = f"{r.choice(names)}{at}{r.choice(['example', 'mail', 'post'])}{dot}{r.choice(['com', 'org', 'net'])}"
        date = r.choice([f"19{num(2)}-0{r.randint(1, 9)}-1{num(1)}", f"1{num(1)}/0{r.randint(1, 9)}/19{num(2)}"])
        true = [
            ("phone", phone), ("call me on", phone), ("tel.", phone), ("mobile:", phone), ("contact", phone),
            ("ssn", ident), ("social security number", ident), ("national id", ident),
            ("iban", iban), ("bank account", iban), ("transfer to", iban), ("pay", iban),
            ("mail me:", mail), ("write to", mail), ("reach me via", mail), ("contact", mail), ("email", mail),
            ("born", date), ("date of birth", date), ("dob:", date), ("birthday", date),
        ]
        false = [
            ("order", phone), ("part number", phone), ("serial", phone), ("the sum of", phone), ("invoice", phone), ("score", phone),
            ("order", ident), ("version", ident), ("batch", ident), ("page", ident), ("about", ident),
            ("serial", iban), ("model", iban), ("sku", iban), ("item", iban),
            ("we stood", "here at noon dot so"), ("it was", "all at once dot then"), ("look", "back at that dot again"),
            ("updated", date), ("release", date), ("issued on", date), ("due", date), ("since", date), ("version", date),
        ]
        good = r.random() < 0.5
        cue, value = r.choice(true if good else false)
        tail = r.choice(["", ", thanks.", " or so", " today."])
        out.append((f"{r.choice(['Well then, ', 'Please note: ', '', 'And so '])}{r.choice([cue, cue.capitalize()])} {value}{tail}", value if good else ""))
    return out


def train(spark: SparkSession, n: int = 900, seed: int = 3, precision: float = 0.97) -> BoostedTrees:
    """Fit on ``n`` invented labelled sentences, two thirds of them; the rest sets each kind's threshold.

    Features come from the very expressions that score the corpus. The corpus has no such labels.
    """
    rows = [(i, t, v) for i, (t, v) in enumerate(_labelled(n, seed))]
    found = candidates(spark.createDataFrame(rows, "i int, t string, v string")).select("i", "v", F.explode("candidates").alias("c")).select("i", "v", "c.*").orderBy("i", "kind", "s").collect()
    x = np.array([[r[f] for f in FEATURES] for r in found])
    y = np.array([float(bool(r.v) and r.m.strip() in r.v or bool(r.v) and r.v in r.m) for r in found])
    fit = np.array([r.i % 3 != 0 for r in found])
    model = BoostedTrees().fit(x[fit], y[fit])
    z = model.logit(x)
    for kind in GENERATORS:
        own = ~fit & np.array([r.kind == kind for r in found])
        cuts = np.unique(z[own])
        good = [c for c in cuts if y[own][z[own] >= c].mean() >= precision]
        model.thresholds[kind] = float(min(good)) - 1e-6 if good else float("inf")
    return model


def find(docs: DataFrame, model: BoostedTrees, into: str = "pii") -> DataFrame:
    """``docs`` with an array of the personal data in each whole text: kind, start, end, score (null: base).

    Positions are code points from 0, ends exclusive. Base matches that fail their check are dropped and
    not tried again. A candidate counts if its score passes its kind's threshold and it meets no base
    span and no better candidate (ties: the earlier, then the kind as listed).

    Null or empty texts: no spans. Rows are independent: no join, no shuffle; equal rows give equal
    results. The work on a text grows with its length. Other columns stay, but for one named ``into``, which is
    replaced; names beginning with ``__pii_`` are used inside.
    """
    own = docs.withColumn("__pii_row", F.struct(*[docs[f"`{c}`"] for c in docs.columns]))
    own = own.select("__pii_row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    needs = {"email": "@", "phone": "+", "ip": ".", "card": None}
    for kind, pattern in BASE.items():
        own = own.withColumn(f"b_{kind}", spans(F.col("t"), pattern, needs[kind]))
    span = lambda k, x, score: F.struct(F.lit(k).alias("kind"), x["s"].cast("long").alias("start"), (x["s"] + F.length(x["m"])).cast("long").alias("end"), score.alias("score"))

    def checked(k):
        return F.transform(F.filter(F.col(f"b_{k}"), lambda x: _holds(k, x["m"])), lambda x: span(k, x, F.lit(None).cast("double")))

    own = own.withColumn("base", F.concat(*[checked(k) for k in BASE_KINDS])).drop(*[f"b_{k}" for k in BASE_KINDS])
    own = candidates(own)
    cut = F.create_map(*[F.lit(x) for k in GENERATORS for x in (k, model.thresholds[k])])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(GENERATORS) for x in (k, i)])
    item = lambda s, e, rank, i, kind: F.struct(s.cast("long").alias("start"), rank.alias("rank"), i.alias("i"), e.cast("long").alias("end"), kind.alias("kind"))
    scored = F.filter(F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), (-model.expression(c)).alias("z"))), lambda c: -c["z"] >= cut[c["kind"]])
    chosen = F.transform(scored, lambda c: item(c["s"], c["e"], c["z"], order[c["kind"]], c["kind"]))
    parts = lambda b: F.sequence(b["start"], b["end"] - 1, F.lit(REACH).cast("long"))
    fixed = F.flatten(F.transform("base", lambda b: F.transform(parts(b), lambda p: item(p, F.least(p + REACH, b["end"]), F.lit(float("-inf")), F.lit(-1), F.lit(None).cast("string")))))
    better = lambda y, x: F.struct(y["rank"], y["start"], y["i"]) < F.struct(x["rank"], x["start"], x["i"])

    def best(items):
        """Candidates that meet nothing better; what they can meet stands near them in the order of starts."""
        near = lambda i: F.slice(items, F.greatest(i + 1 - NEIGHBOURS, F.lit(1)), 2 * NEIGHBOURS + 1)
        return F.filter(items, lambda x, i: (x["i"] >= 0) & ~F.exists(near(i), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & better(y, x)))

    own = own.withColumn("chosen", chosen)
    kept = let(F.sort_array(F.concat("chosen", fixed)), best)
    more = F.concat("base", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (1 / (1 + F.exp(x["rank"]))).alias("score"))))
    more = F.when(F.size("chosen") > 0, more).otherwise(F.col("base"))
    return own.select(*[F.col(f"__pii_row.`{c}`") for c in docs.columns if c.lower() != into.lower()], more.alias(into))


def span_text(all_spans: Column) -> Column:
    """kind:start:end by start, then by kind as listed."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.sort_array(F.transform(all_spans, lambda x: F.struct(x["start"].alias("a"), order[x["kind"]].alias("b"), x["end"].alias("c"), x["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["a"].cast("string"), x["c"].cast("string"))), ",")


def redact(docs: DataFrame, model: BoostedTrees, mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span of ``find`` in ``text`` replaced by its kind; columns unchanged."""
    name = "__pii_spans"
    found = find(docs, model, name)
    ordered = F.sort_array(F.transform(name, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), x["kind"].alias("k"))))

    def masked(spans_here):
        ends = running(F.transform(spans_here, lambda x: x["b"].cast("int")), F.greatest, F.lit(0))

        def use(own):
            chars, before = own["chars"], own["ends"]
            kept = lambda x, i: F.array_join(F.slice(chars, F.get(before, i) + 1, F.greatest(x["a"].cast("int") - F.get(before, i), F.lit(0))), "")
            # a span that begins inside another adds nothing of its own
            part = lambda x, i: F.concat(kept(x, i), F.when(x["a"] >= F.get(before, i), F.format_string(mask.replace("{}", "%s"), x["k"])).otherwise(""))
            last = F.array_max(F.transform(spans_here, lambda x: x["b"].cast("int")))
            return F.concat(F.array_join(F.transform(spans_here, part), ""), F.array_join(F.slice(chars, last + 1, F.size(chars)), ""))

        return let(F.struct(F.split("text", "").alias("chars"), ends.alias("ends")), use)

    text = let(ordered, masked)
    return found.withColumn("text", F.when(F.size(name) > 0, text).otherwise(F.col("text"))).drop(name)


def report(docs: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    model = model or train(docs.sparkSession)
    found = find(docs.select("doc_id", "text"), model, "found_spans")
    s = F.col("found_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(F.filter(s, lambda x: x["kind"].isin(BASE_KINDS))), 256).alias("base_sha256"),
        span_text(s).alias("spans"),
    )
