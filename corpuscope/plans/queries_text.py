"""Queries of the lexical and path operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuscope.functions import paths, text
from corpuscope.operators import filters, lexical
from corpuscope.plans.registry import query
from corpuscope.plans.views import FILES_SQL, files, table
from corpuscope.session import shared_folder, spread
from corpuscope.sources import repository

TOK = "list_transform(list_filter(string_split_regex(replace({}, '()', ''), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"
BM25_TERMS = ["licensed", "under", "the", "apache", "license", "license"]


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def code_tokens(spark, sf):
    t = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.code_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def bm25_sql(terms):
    """WITH terms that end in s (doc_id, score) for a query's terms."""
    return f"""WITH tok AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM tok) GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n),
fl AS (SELECT avg(idf) * 0.25 AS floor FROM idf),
q AS (SELECT unnest({terms!r}) AS term),
w AS (SELECT q.term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM q JOIN idf USING (term), fl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
s AS (SELECT tf.doc_id, sum(w.idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))) AS score FROM tf JOIN w USING (term) JOIN tok USING (doc_id), n GROUP BY tf.doc_id)
"""


BM25_SQL = bm25_sql(BM25_TERMS)


@query(BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    s = lexical.bm25(d, "doc_id", "text", BM25_TERMS)
    return s.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 50")
def bm25_stored(spark, sf):
    """Build the stored index, then answer from it."""
    path = f"{shared_folder(spark)}/views/bm25-{uuid.uuid4().hex}"
    lexical.write_bm25(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", path)
    s = lexical.bm25_stored(spark, path, "doc_id", BM25_TERMS)
    return s.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


@query(BM25_SQL + ", c AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 15) SELECT doc_id, 0.0::DOUBLE AS score, round(score, 6) AS bm25 FROM c WHERE doc_id % 2 = 0 ORDER BY c.score DESC, doc_id LIMIT 5")
def bm25_search_capped(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    s = lexical.bm25_search(d, "doc_id", "text", BM25_TERMS, 5, keep=F.col("doc_id") % 2 == 0)
    return s.select("doc_id", "score", F.round("bm25", 6).alias("bm25"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL HAVING count(*) >= 20")
def postings_heavy_terms(spark, sf):
    return lexical.postings(table(spark, sf, "documents"), "doc_id", "text").filter("tf >= 20").select("doc_id", "term", "tf")


@query(
    r"""SELECT vid, file,
  regexp_matches(lower(file), '(^|/)(test|tests|testing|spec|specs|__tests__)(/|$)') OR regexp_matches(lower(file), '(^|/)test_[^/]*$') OR regexp_matches(lower(file), '(_tests?|_spec|-tests?|-spec)(\.[^./]*)?$')
    OR regexp_matches(lower(file), '\.(test|spec)\.[^/]*$') OR regexp_matches(file, '(Tests?|Spec)(\.[^./]*)?$') AS test_path,
  regexp_matches(lower(file), '(^|/)(test|tests|__tests__|spec|specs)/') OR regexp_matches(lower(file), '(^|/)test[^/]*$') AS test_file,
  regexp_matches(file, '(^|/)(dist|build|out|node_modules|vendor)/') OR regexp_matches(file, '(\.min\.js|\.d\.ts|\.map)$') AS non_source,
  regexp_matches(file, '\.(py|ts|js)$') AS source, file LIKE '%.d.ts' AS declaration, NOT (contains(file, '/build/') OR contains(file, '/.hidden/')) AS visible,
  NOT (file LIKE 'src1%/tests/%') AS kept, file LIKE '%.py' AS python FROM files""",
    FILES_SQL,
)
def path_predicates(spark, sf):
    f = F.col("file")
    return files(spark, sf).select(
        "vid", "file", paths.is_test_path(f).alias("test_path"), paths.is_test_file(f).alias("test_file"), paths.is_non_source_file(f).alias("non_source"), paths.is_source_file(f).alias("source"),
        paths.is_declaration_file(f).alias("declaration"), paths.is_visible(f).alias("visible"), paths.exclude_paths(f, ["src1*/tests/*"]).alias("kept"), paths.include_extensions(f, ["py"]).alias("python"),
    )


@query(
    r"""SELECT vid, file FROM files WHERE (file LIKE '%.py' OR file LIKE '%.js') AND NOT file LIKE '%.min.js' AND NOT contains(file, '/tests/') AND NOT contains(file, '/test_')
  AND len(list_filter(string_split(content, chr(10)), lambda x: length(x) > 10000)) = 0""",
    FILES_SQL,
)
def source_file_filter(spark, sf):
    return files(spark, sf).filter(paths.source_filter(F.col("file"), F.col("content"), [".py", ".js"], ["*.min.js"])).select("vid", "file")


@query("SELECT vid, file FROM files WHERE trim(content) <> '' AND NOT contains(lower(file), 'test') AND file LIKE '%.py' ORDER BY vid LIMIT 50", FILES_SQL)
def filter_candidates(spark, sf):
    rows = files(spark, sf).withColumn("rank", F.col("vid"))
    wanted = filters.candidate_filters(require_content=True, drop_tests=True, include_exts=["py"])
    return filters.filter_candidates(rows, wanted, 50).select("vid", "file")


@query(
    r"""WITH h AS (SELECT *, len(regexp_extract_all(content, '(^|[^A-Za-z0-9_])token[ \t\n\r]*\(')) AS calls FROM files WHERE regexp_matches(content, '(^|[^A-Za-z0-9_])token([^A-Za-z0-9_]|$)') AND name <> 'token')
SELECT vid, file, CAST(calls AS BIGINT) AS calls, CASE WHEN calls > 0 THEN calls ELSE 1 END::DOUBLE AS score FROM h ORDER BY calls DESC, vid LIMIT 20""",
    FILES_SQL,
)
def identifier_occurrences(spark, sf):
    chunks = files(spark, sf).withColumn("position", F.col("vid")).withColumn("node_id", F.col("file"))
    return lexical.identifier_occurrences(chunks, "token()", "", 20).select("vid", "file", "calls", "score")


@query(r"SELECT vid, file FROM files WHERE regexp_matches(substr(content, 1, 8000), '(?i)licen[sc]ed under .* version') AND file LIKE 'src%' ORDER BY vid LIMIT 100", FILES_SQL)
def regex_search(spark, sf):
    return lexical.regex_search(files(spark, sf), "licen[sc]ed under .* version", 100, file_glob="src*").select("vid", "file")


@query("SELECT vid, file FROM files WHERE contains(lower(substr(content, 1, 8000)), 'all rights reserved') ORDER BY vid LIMIT 100", FILES_SQL)
def plain_search(spark, sf):
    return lexical.regex_search(files(spark, sf), "All Rights reserved", 100, plain=True).select("vid", "file")


@query(
    r"""SELECT file, CAST(n AS BIGINT) AS line_no, line FROM (SELECT file, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files) WHERE regexp_matches(line, 'password=[0-9a-f]+')""",
    FILES_SQL,
)
def grep_content(spark, sf):
    return lexical.grep(files(spark, sf), "password=[0-9a-f]+")


@query(
    r"""SELECT file, count(*) AS matches FROM (SELECT file, unnest(string_split(content, chr(10))) AS line FROM files WHERE file LIKE '%.py') WHERE regexp_matches(line, 'the') GROUP BY file""",
    FILES_SQL,
)
def grep_count(spark, sf):
    return lexical.grep(files(spark, sf), "the", "count", glob="*.py")


@query("SELECT file FROM files WHERE regexp_matches(file, '^src1.*/src/mod.*[.]py$')", FILES_SQL)
def glob_files(spark, sf):
    return lexical.glob(files(spark, sf), "src1*/src/mod*.py")


TRIGRAM_SQL = r"""SELECT file, CAST(min(n) AS BIGINT) AS first_line, CAST(max(n) AS BIGINT) AS last_line, string_agg('L' || n || ': ' || line, chr(10) ORDER BY n) AS fragments
FROM (SELECT file, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files) WHERE contains(lower(line), 'mit license') GROUP BY file"""


@query(TRIGRAM_SQL, FILES_SQL)
def trigram_search(spark, sf):
    """Without an index every file is looked at once."""
    return lexical.trigram_search(files(spark, sf).select("file", "content"), "MIT License")


@query(TRIGRAM_SQL, FILES_SQL)
def trigram_stored(spark, sf):
    """Build the stored index, then open only the files that hold all trigrams."""
    f, path = files(spark, sf).select("file", "content"), f"{shared_folder(spark)}/views/trigrams-{uuid.uuid4().hex}"
    lexical.write_trigrams(f, path)
    return lexical.trigram_search(f, "MIT License", lexical.stored_trigrams(spark, path, "MIT License"))


@query(
    """SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and')))), ' ') AS terms FROM benchmark"""
)
def focus_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.focus_terms(F.col("text"), ["the", "and"]), " ").alias("terms"))


@query(
    """WITH w AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_extract_all(lower(p_name || '_' || p_type), '[a-z]+|[0-9]+'), lambda x: length(x) >= 3))) AS t FROM part),
s AS (SELECT p_partkey, t FROM w UNION SELECT p_partkey, left(t, CAST(length(t) - length(x) AS BIGINT)) FROM w, (VALUES ('ing'), ('ers'), ('er'), ('ments'), ('ment'), ('es'), ('s')) v(x) WHERE length(t) > length(x) + 2 AND ends_with(t, x))
SELECT p_partkey, string_agg(t, ' ' ORDER BY t) AS terms FROM s GROUP BY p_partkey"""
)
def subword_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.subword_terms(F.concat_ws("_", F.initcap("p_name"), "p_type")), " ").alias("terms"))


@query(
    r"""WITH p AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z]+|[0-9]+'), lambda x: length(x) > 1 AND x NOT IN ('old', 'new'))) AS gt, list_distinct(list_transform(regexp_extract_all(p_type || ' ' || split_part(p_name, ' ', 1), '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x))) AS q FROM part)
SELECT p_partkey, round(len(list_intersect(gt, q)) / len(gt), 6) AS leak, len(list_intersect(gt, q)) / len(gt) > 0.5 AS flagged FROM p WHERE len(gt) > 0"""
)
def vocab_overlap(spark, sf):
    p = table(spark, sf, "part")
    gt = text.leak_tokens(F.regexp_replace("p_name", " ", "_"))
    q = text.query_words(F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1)))
    leak = F.size(F.array_intersect(gt, q)) / F.size(gt)
    return p.filter(F.size(gt) > 0).select("p_partkey", F.round(leak, 6).alias("leak"), (leak > 0.5).alias("flagged"))


@query(
    r"""WITH d AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(text), '[`*_\[\]()#>/-]', ' ', 'g'), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ('an','and','are','as','at','be','by','for','from','in','into','is','it','of','on','or','that','the','then','this','through','to','with'))) AS t FROM conversations)
SELECT a.conv_id, a.turn AS "left", b.turn AS "right", round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS overlap FROM d a JOIN d b ON a.conv_id = b.conv_id AND a.turn < b.turn
WHERE len(a.t) >= 5 AND len(b.t) >= 5 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.25"""
)
def near_dup_pairs(spark, sf):
    return lexical.near_duplicate_sentences(table(spark, sf, "conversations"), "conv_id", "turn", "text", 5, 0.25).withColumn("overlap", F.round("overlap", 6))


@query(
    r"""SELECT md5(b) AS block, count(*) AS copies, min(doc_id) AS first_key FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) AS b FROM documents) GROUP BY b HAVING count(*) > 1"""
)
def duplicate_blocks(spark, sf):
    return lexical.duplicate_blocks(table(spark, sf, "documents"), "text", "doc_id")


def _any_sql(patterns, flags=""):
    return "regexp_matches(text, '" + flags + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


SIGNALS_SQL = f"""WITH c AS (SELECT conv_id, turn, {_any_sql(text.LEXICAL)} AS l, {_any_sql([text.SEMANTIC], '(?i)')} AS s, {_any_sql(text.STRUCTURAL, '(?i)')} AS structural, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n FROM conversations)
SELECT conv_id, turn, l OR (NOT (s OR n >= 10) AND n BETWEEN 1 AND 4) AS lexical, s OR n >= 10 AS semantic, structural FROM c"""


@query(SIGNALS_SQL)
def query_signals(spark, sf):
    lexical_, semantic, structural = text.query_signals(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", lexical_.alias("lexical"), semantic.alias("semantic"), structural.alias("structural"))


@query(
    r"""WITH x AS (SELECT vid, list_transform(regexp_extract_all(content, '`([^`\n]{2,60})`', 1), lambda x: trim(x)) || list_filter(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda x: regexp_matches(x, '_|[a-z][A-Z]') OR (upper(x) = x AND regexp_matches(x, '[A-Z]'))) AS l FROM files),
y AS (SELECT vid, list_filter(l, lambda x: x NOT IN ('BUG', 'TODO', 'FIXME', 'NOTE', 'XXX', 'HACK', 'WARNING', 'ERROR')) AS l FROM x)
SELECT vid, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], ' ') AS identifiers FROM y WHERE len(l) > 0""",
    FILES_SQL,
)
def query_identifiers(spark, sf):
    return files(spark, sf).select("vid", F.array_join(text.query_identifiers(F.col("content")), " ").alias("identifiers")).filter("identifiers <> ''")


@query("SELECT page_id, true AS marked, regexp_matches(lower(html), '^\\s*<!--[^>]*generated') AS plain FROM pages")
def generated_markers(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.has_generated_marker(F.concat(F.lit("# Code generated by a tool, DO NOT EDIT\n"), "html")).alias("marked"), text.has_generated_marker(F.col("html")).alias("plain"))


@query(
    """SELECT vid, md5(array_to_string(list_slice(string_split(content, chr(10)), CAST(vid % 3 + 1 AS BIGINT), CAST(vid % 3 + 3 AS BIGINT)), chr(10))) AS window_md5 FROM files""",
    FILES_SQL,
)
def read_source_window(spark, sf):
    f = files(spark, sf)
    return f.select("vid", F.md5(text.lines_between(F.col("content"), (F.col("vid") % 3).cast("int"), (F.col("vid") % 3 + 2).cast("int"))).alias("window_md5"))


@query(
    """SELECT name, sha256(string_agg(file || ':' || sha256(coalesce(content, '')), chr(10) ORDER BY file)) AS fingerprint FROM files GROUP BY name""",
    FILES_SQL,
)
def repository_fingerprint(spark, sf):
    return repository.fingerprint(files(spark, sf), "name")


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS ext, substr(url, 1, 5) = 'https' AS secure, CASE WHEN length(url) <= 24 THEN url ELSE substr(url, 1, 10) || ' ... ' || substr(url, length(url) - 8) END AS short FROM pages"""
)
def url_labels(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract(u, r"(\.[^./]+)$", 1)).alias("ext"), u.startswith("https").alias("secure"), text.elide_middle(u, 24).alias("short"))


@query(
    """SELECT type AS language, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files GROUP BY type""", FILES_SQL
)
def repository_statistics(spark, sf):
    return files(spark, sf).groupBy(F.col("type").alias("language")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"), F.sum(F.size(F.split("content", "\n", -1))).alias("lines"))


@query()
def chunk_source(spark, sf):
    """Chunks of Python built from the parts: one class a brand with a method a part."""
    body = F.concat(F.lit("    def part_"), F.col("p_partkey").cast("string"), F.lit("(self):\n        return "), F.col("p_size").cast("string"))
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(body)), "\n").alias("b"))
    f = p.select(F.concat(F.regexp_replace("p_brand", "#", "_"), F.lit(".py")).alias("file"), F.lit("python").alias("language"), F.concat(F.lit("class "), F.regexp_replace("p_brand", "#", "_"), F.lit(":\n"), "b").alias("content"))
    return repository.chunk(f).select("node_id", "chunk_type", "start_line", "end_line")
