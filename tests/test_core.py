"""The engine's own operators: registered queries against SQL, and semantics on small cases."""

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from corpuscope.functions import paths, text
from corpuscope.operators import catalog, evaluation, facts, graph, incremental, intervals, lexical, ranking, vectors
from corpuscope.plans import planner
from corpuscope.sources import repository
from corpuscope.streaming import commits

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "code_tokens", "bm25_topk", "path_predicates", "identifier_occurrences", "trigram_search", "fusion_weighted", "fusion_rrf", "file_rrf", "interval_union", "vector_topk_l2", "hierarchical_search", "innermost_scope",
    "definitions_at", "ndcg_line_budget", "edge_layers", "bfs_impact", "ppr_fixed_iter", "hub_prune", "moniker_resolve", "retrieval_metrics_at_k", "win_tie_loss", "pareto_front", "chunk_delta", "manifest_join", "near_dup_pairs",
    "bm25_stored", "trigram_stored", "region_metrics", "planned_search", "graph_seeded_search", "greedy_span_dedup", "query_identifiers", "leak_guard", "diff_hunks", "supporting_evidence", "node_spans", "symbol_spans", "edge_staging",
    "affected_symbols", "location_summary", "file_tree", "payload_store", "path_normalisation", "query_selection", "action_identifiers", "lsp_route", "dense_graph_search", "snapshot_at", "trace_path", "windowed_activity", "chunk_prefix", "communities", "renamed_files", "surface_classes", "range_query_by_symbol", "symbol_normalisation", "stage_fusion",
]


def plain(x):
    import pandas as pd

    if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 6) if isinstance(x, float) or (isinstance(x, int) and not isinstance(x, bool)) else x


def rows_of(frame):
    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert rows_of(got) == rows_of(want)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def branch(spark, rows):
    return spark.createDataFrame(rows, "branch long, rank long, node_id string, file string, score double, content string")


def test_fusion_semantics(spark):
    rows = branch(spark, [(0, 1, "a", "f", 0.0, ""), (0, 2, "b", "f", 0.5, "b"), (0, 3, "a", "f", None, "later"), (1, 1, "b", "g", 2.0, "")])
    weighted = {r.node_id: r for r in ranking.fuse(rows, "node_id", "weighted", {0: 2.0}).collect()}
    assert weighted["a"].score == pytest.approx(2 * (1 + 1 / 3)) and weighted["a"].content == "later" and weighted["a"].rank == 1
    rrf = {r.node_id: r.score for r in ranking.fuse(rows, "node_id", "rrf").collect()}
    assert rrf["a"] == pytest.approx(1 / 61 + 1 / 63)  # a repeat in one branch counts again
    once = {r.node_id: r for r in ranking.provenance_rrf(rows, "node_id").collect()}
    assert once["a"].score == pytest.approx(1 / 61) and once["b"].routes == [0, 1]
    with pytest.raises(ValueError):
        ranking.fuse(rows, "node_id", "other")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 6)), max_size=20))
def test_interval_union_property(spark, items):
    spans = [(g, s, s + n) for g, s, n in items]
    df = spark.createDataFrame(spans, "g int, s int, e int")
    got = sorted(map(tuple, ranking.interval_union(df, "g", "s", "e").collect()))
    want = []
    for g, s, e in sorted(spans):
        if want and want[-1][0] == g and s <= want[-1][2] + 1:
            want[-1] = (g, want[-1][1], max(want[-1][2], e))
        else:
            want.append((g, s, e))
    assert got == want


def test_greedy_dedup_is_not_transitive(spark):
    df = spark.createDataFrame([("q", 1, "f", 0, 10), ("q", 2, "f", 8, 20), ("q", 3, "f", 18, 30)], "q string, rank int, file string, s int, e int")
    assert [r.rank for r in intervals.greedy_dedup(df, "q", "rank", "file", "s", "e").orderBy("rank").collect()] == [1, 3]


def test_paths(spark):
    df = spark.createDataFrame([("a/tests/x.py",), ("a/x_test.go",), ("a/FooTest.java",), ("test.py",), ("a/../b/./c.py",), ("../x",), ("/abs",), (None,), ("a\\spec\\b.js",)], "p string")
    out = {r.p: r for r in df.select("p", paths.is_test_path(F.col("p")).alias("a"), paths.is_test_file(F.col("p")).alias("b"), paths.normalize(F.col("p")).alias("n")).collect()}
    assert [out[p].a for p in ("a/tests/x.py", "a/x_test.go", "a/FooTest.java", "test.py", None)] == [True, True, True, False, False]
    assert [out[p].b for p in ("a/tests/x.py", "a/x_test.go", "a/FooTest.java", "test.py", None)] == [True, False, False, True, False]
    assert out["a/../b/./c.py"].n == "b/c.py" and out["../x"].n is None and out["/abs"].n is None and out["a\\spec\\b.js"].a


def test_generated_marker_and_identifiers(spark):
    df = spark.createDataFrame([("# Code generated by x. DO NOT EDIT.\nx = 1",), ("x = 1\n# generated by y",), ("/* a\n do not manually edit */\nint x;",), ("see `Foo.bar` and foo_bar or LPOP, TODO",)], "t string")
    got = [r.m for r in df.select(text.has_generated_marker(F.col("t")).alias("m")).collect()]
    assert got == [True, False, True, False]
    assert df.select(text.query_identifiers(F.col("t")).alias("i")).collect()[3].i == ["Foo.bar", "foo_bar", "LPOP"]


SOURCES = {
    'go': (
        'package x\n// func no() {\ntype Stack[T any] struct {\n  a []T\n}\nfunc (s *Stack[T]) Push(x T) {\n  if x { y() }\n}\nfunc main() {\n  f := func() { return }\n  s := "}"\n}\ntype R interface {\n  Read()\n}\n',
        [('class', 'Stack', 2, 4), ('method', 'Stack.Push', 5, 7), ('function', 'main', 8, 11), ('class', 'R', 12, 14)],
    ),
    'java': (
        'package a;\npublic class Foo<T> extends B {\n  private int x = 1;\n  public Foo(int a) { this.x = a; }\n  @Override\n  public String bar(List<String> a) throws E {\n    if (a) { return "{"; }\n    for (int i : a) { x(); }\n  }\n  interface In { void q(); }\n  abstract void none();\n}\nenum E { A, B }\n',
        [('class', 'Foo', 1, 11), ('method', 'Foo.Foo', 3, 3), ('method', 'Foo.bar', 5, 8), ('class', 'Foo.In', 9, 9), ('class', 'E', 12, 12)],
    ),
    'rust': (
        "mod m {\n  pub fn inner() {}\n}\npub struct P { a: i32 }\nimpl<T> Foo for P {\n  fn go(&self) -> i32 { let c = '}'; 1 }\n  pub async fn two() {}\n}\nfn main() { let x = || { 1 }; }\ntrait Q { fn sig(&self); fn has() {} }\n",
        [('function', 'inner', 1, 1), ('class', 'P', 3, 3), ('class', 'P', 4, 7), ('method', 'P.go', 5, 5), ('method', 'P.two', 6, 6), ('function', 'main', 8, 8), ('class', 'Q', 9, 9)],
    ),
    'cpp': (
        '#include <a>\nnamespace n {\nclass A : public B {\n public:\n  A();\n  int get() const { return 1; }\n};\nint A::set(int x) {\n  while (x) { x--; }\n  return x;\n}\n}\nstatic void f(int a, char *b)\n{\n  if (a) { }\n}\nint proto(int);\ntemplate <typename T> T g(T x) { return x; }\n',
        [('class', 'A', 2, 6), ('method', 'A.get', 5, 5), ('method', 'A.set', 7, 10), ('function', 'f', 12, 15), ('function', 'g', 17, 17)],
    ),
    'javascript': (
        'export function a(x) { return {}; }\nconst b = (x) => {\n  return 1;\n};\nclass C extends D {\n  constructor(a) { super(a); }\n  static async go() { if (x) { y(); } }\n}\nfoo(1, () => { });\n',
        [('function', 'a', 0, 0), ('function', 'b', 1, 3), ('class', 'C', 4, 7), ('method', 'C.constructor', 5, 5), ('method', 'C.go', 6, 6)],
    ),
    'typescript': (
        'export interface I { a: string; m(): void }\nexport class S<T> {\n  private x: number;\n  get(a: string): Promise<T> {\n    return a;\n  }\n}\nexport const f = async (a: number): Promise<void> => {\n  a;\n}\n',
        [('class', 'I', 0, 0), ('class', 'S', 1, 6), ('method', 'S.get', 3, 5), ('function', 'f', 7, 9)],
    ),
    'kotlin': (
        'data class P(val a: Int)\nclass A {\n  fun go(x: Int): Int {\n    return x\n  }\n  fun one() = 1\n}\nfun top() { }\n',
        [('class', 'P', 0, 0), ('class', 'A', 1, 6), ('method', 'A.go', 2, 4), ('method', 'A.one', 5, 5), ('function', 'top', 7, 7)],
    ),
    'scala': (
        'object O {\n  def main(a: Int): Unit = {\n    println(a)\n  }\n  def one = 1\n}\nclass K(x: Int)\n',
        [('class', 'O', 0, 5), ('method', 'O.main', 1, 3), ('method', 'O.one', 4, 4), ('class', 'K', 6, 6)],
    ),
    'swift': (
        'struct S {\n  var a: Int\n  init(a: Int) { self.a = a }\n  func go() -> Int { return 1 }\n}\nfunc top() { }\n',
        [('class', 'S', 0, 4), ('method', 'S.init', 2, 2), ('method', 'S.go', 3, 3), ('function', 'top', 5, 5)],
    ),
    'php': (
        '<?php\nclass A {\n  # comment {\n  public function go($x) { if ($x) { } return 1; }\n}\nfunction top() { }\n',
        [('class', 'A', 1, 4), ('method', 'A.go', 3, 3), ('function', 'top', 5, 5)],
    ),
    'ruby': (
        'module M\n  class A\n    def go(x)\n      if x\n        1\n      end\n      y = 2 if x\n    end\n    def self.z?; end\n  end\nend\ndef top\n  [1].each do |x|\n    x\n  end\nend\n',
        [('class', 'M', 0, 10), ('class', 'M.A', 1, 9), ('method', 'M.A.go', 2, 7), ('method', 'M.A.z?', 8, 8), ('function', 'top', 11, 15)],
    ),
    'lua': (
        'local function a(x)\n  if x then return 1 end\n  for i = 1, 2 do b() end\nend\nfunction M.go(x)\n  while x do y() end\nend\nM.z = function(q) return q end\n',
        [('function', 'a', 0, 3), ('method', 'M.go', 4, 6), ('method', 'M.z', 7, 7)],
    ),
    'csharp': (
        'namespace N {\n  public class A : B {\n    public int X { get; set; }\n    public A(int a) { }\n    public async Task<int> Go(string s) { if (s) { } return 1; }\n  }\n}\n',
        [('class', 'A', 1, 5), ('method', 'A.A', 3, 3), ('method', 'A.Go', 4, 4)],
    ),
}


@pytest.mark.parametrize("language", list(SOURCES))
def test_definitions_of_languages(language):
    """Nested members carry their owner, extents end with their block, comments and strings count for nothing."""
    source, want = SOURCES[language]
    assert repository.definitions(source, language) == want


def message(*pairs):
    """A protobuf message: numbers as varints, bytes and texts with their length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in pairs:
        if isinstance(v, int):
            out += varint(k << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(k << 3 | 2) + varint(len(v)) + v
    return out


def test_symbol_index(spark, tmp_path):
    from corpuscope.sources import symbol_index

    occ = lambda span, symbol, roles=0: (2, message((1, bytes(span)), (2, symbol), (3, roles)))
    a = message((1, "a.py"), occ([0, 4, 7], "pkg/A#", 1), occ([1, 4, 2, 9], "pkg/A#go().", 1), occ([2, 8, 10], "local 1", 1), occ([3, 8, 10], "local 1"), occ([3, 12, 15], "pkg/B#"), (3, message((1, "pkg/A#go()."), (5, 26), (6, "go"), (8, "pkg/A#"), (4, message((1, "pkg/B#"), (3, 1))))), (9, b"new"))
    b = message((1, "b/b.py"), occ([300 & 127, 0, 3], "pkg/B#", 1), occ([9, 0, 3], "pkg/A#"), occ([10, 0, 3], "pkg/Unknown#"))
    (tmp_path / "x.scip").write_bytes(message((1, message((1, 0))), (2, a), (2, b)))
    occurrences, symbols = symbol_index.read_index(spark, str(tmp_path))
    rows = occurrences.orderBy("file", "start_line", "start_char").collect()
    assert len(rows) == 8 and tuple(rows[1]) == ("a.py", 1, 4, 2, 9, "pkg/A#go().", 1) and tuple(rows[0])[1:5] == (0, 4, 0, 7)
    vertices, edges = symbol_index.index_graph(occurrences, symbols)
    assert {r.name for r in vertices.collect()} == {"a.py", "b/b.py", "pkg/A#", "pkg/A#go().", "pkg/B#", "a.py#local 1"}
    got = {(r.src, r.dst, r.type, r.anchor_line) for r in edges.collect()}
    assert {("pkg/A#go().", "pkg/B#", "reference", 3), ("pkg/A#go().", "a.py#local 1", "reference", 3), ("a.py", "pkg/A#", "contain", None), ("pkg/A#", "pkg/A#go().", "contain", None), ("b/b.py", "pkg/A#", "reference", 9), ("pkg/A#go().", "pkg/B#", "implementation", None)} <= got
    with pytest.raises(ValueError):
        list(symbol_index.fields(b"\x12\x7fab"))
    tree = [{"name": "A", "kind": 5, "range": {"start": {"line": 0}, "end": {"line": 9}}, "children": [{"name": "go", "kind": 6, "range": {"start": {"line": 1}, "end": {"line": 2}}}]}, {"name": "f", "kind": 12}]
    flat = symbol_index.flatten_symbols(spark.createDataFrame([("a.py", json.dumps(tree)), ("b.py", None)], "file string, symbols string")).collect()
    assert [(r.name, r.parent, r.depth, r.start_line) for r in flat] == [("A", None, 0, 0), ("A.go", "A", 1, 1), ("f", None, 0, None)]


def test_metrics_without_hits_and_repeats(spark):
    p = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b")], "q string, rank int, item string")
    t = spark.createDataFrame([("q", "a"), ("q", "c"), ("r", "a")], "q string, item string")
    out = {(r.q, r.k): r for r in evaluation.metrics_at_k(p, t, "q", "item", [2], distinct=False).collect()}
    assert out["q", 2].precision == 0.5 and out["q", 2].recall == 0.5 and out["r", 2].recall == 0
    assert {(r.q, r.k): r for r in evaluation.metrics_at_k(p, t, "q", "item", [2]).collect()}["q", 2].precision == 0.5


def test_graph_paths_and_moves(spark):
    e = spark.createDataFrame([(i, a, b, "reference", None, None) for i, (a, b) in enumerate([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)])], "eid long, src long, dst long, type string, anchor_file string, anchor_line long")
    assert [r.vid for r in graph.shortest_path(e, 1, 4).orderBy("step").collect()] == [1, 2, 3, 4]
    assert graph.shortest_path(e, 4, 1).count() == 0 and graph.distance(e, 4, 1) == 3 and graph.distance(e, 4, 9) == -1
    seeds = spark.createDataFrame([(1,)], "vid long")
    assert {r.vid: r.depth for r in graph.bfs(e, seeds, 2).collect()} == {1: 0, 2: 1, 3: 2}
    rank = {r.vid: r.rank for r in graph.personalized_pagerank(e, seeds, 30).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank[1] > rank[4]


def test_delta_and_overlay_converge(spark):
    old = spark.createDataFrame([("f", "l0", "a"), ("f", "l0", "b")], "file string, level string, content_hash string")
    new = spark.createDataFrame([("f", "l0", "b"), ("f", "l0", "c"), ("f", "l0", "c")], "file string, level string, content_hash string")
    d = incremental.chunk_delta(old, new)
    assert sorted((r.content_hash, r.change) for r in d.collect()) == [("a", "removed"), ("c", "added")]
    applied = old.join(d.filter("change = 'removed'"), ["file", "level", "content_hash"], "left_anti").union(d.filter("change = 'added'").drop("change"))
    assert facts.snapshot_diff(applied.withColumn("k", F.col("content_hash")), new.distinct().withColumn("k", F.col("content_hash")), "k", "content_hash").count() == 0


def test_commit_stream(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    batches = [[(1, "a", "x", False), (2, "b", "y", False)], [(3, "a", "z", False), (4, "b", "", True)]]
    for n, batch in enumerate(batches):
        with open(source / f"c{n}.json", "w") as f:
            for seq, file, content, gone in batch:
                f.write(json.dumps({"seq": seq, "file": file, "level": "l0", "content": content, "deleted": gone}) + "\n")
        commits.start(spark, str(source), str(root)).awaitTermination()
    assert [(r.file, r.content) for r in spark.read.parquet(f"{root}/versions/v1").collect()] == [("a", "z")]
    assert spark.read.parquet(f"{root}/deltas/v1").count() == 3
    state = spark.createDataFrame([(5, "a", "l0", None, True, None)], commits.STATE_SCHEMA)
    late = commits.applied(state, spark.createDataFrame([(4, "a", "l0", "old", False), (6, "c", "l0", "new", False)], commits.COMMIT_SCHEMA))
    assert [r.file for r in commits.live_chunks(late).collect()] == ["c"]  # a late change does not undo a deletion


def test_chunks_of_a_repository(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "pkg/a.py").write_text("class A:\n    def f(self):\n        return 1\n\n\ndef g():\n    return 2\n")
    (tmp_path / "pkg/b.go").write_text("package b\n\nfunc Run() int {\n\treturn 1\n}\n")
    (tmp_path / "pkg/bad.py").write_text("def (:\n")
    (tmp_path / ".git/x.py").write_text("x = 1\n")
    files = repository.discover(spark, str(tmp_path))
    assert sorted(r.file for r in files.collect()) == ["pkg/a.py", "pkg/b.go", "pkg/bad.py"]
    ids = {r.node_id: (r.start_line, r.end_line) for r in repository.chunk(files).collect()}
    assert ids == {"pkg/a.py:A": (0, 2), "pkg/a.py:A.f()": (1, 2), "pkg/a.py:g()": (5, 6), "pkg/b.go:Run()": (2, 4), "pkg/bad.py": (0, 1)}
    with pytest.raises(Exception, match="."):
        repository.chunk(files, strict=True).collect()


def test_catalog_refs_move_only_as_expected(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}")
    g = c.stage("chunks", spark.range(3))
    first = c.publish("main", {"chunks": g}, None)
    assert c.read("main", "chunks").count() == 3
    with pytest.raises(RuntimeError):
        c.publish("main", {"chunks": g}, None)
    assert c.publish("main", {"chunks": c.stage("chunks", spark.range(5))}, first) != first
    assert c.read("main", "chunks").count() == 5
    assert c.versions("main") == [1, 2] and c.resolve("main", 1)["snapshot"] == first and c.resolve("other") is None
    # a second writer that saw the same version finds its number taken
    late = catalog.Catalog(spark, f"file://{tmp_path}")
    late.versions = lambda ref: [1]
    with pytest.raises(RuntimeError):
        late.publish("main", {"chunks": g}, first)
    assert c.read("main", "chunks").count() == 5


def test_leases_and_fencing(spark):
    rows = [
        ("a", 1, "create", None, 0, 0, 0), ("a", 2, "lease", "w1", 0, 10, 5), ("a", 3, "lease", "w2", 0, 12, 5), ("a", 4, "renew", "w1", 1, 13, 5), ("a", 5, "lease", "w2", 0, 18, 5), ("a", 6, "finish", "w1", 1, 19, 0), ("a", 7, "finish", "w2", 2, 20, 0), ("a", 8, "cancel", None, 0, 21, 0),
        ("b", 1, "create", None, 0, 0, 0), ("b", 2, "lease", "w1", 0, 1, 5), ("b", 3, "fail", "w1", 1, 2, 0), ("b", 4, "create", None, 0, 3, 0), ("c", 1, "finish", "w", 0, 1, 0), ("d", 1, "create", None, 0, 0, 0), ("d", 2, "cancel", None, 0, 1, 0), ("d", 3, "lease", "w", 0, 2, 5),
    ]
    out = {r.job: (r.state, r.token, r.worker, r.refused) for r in catalog.fold_leases(spark.createDataFrame(rows, "job string, seq long, kind string, worker string, token long, at long, ttl long")).collect()}
    assert out == {"a": ("finished", 2, "w2", 3), "b": ("queued", 1, None, 1), "c": (None, 0, None, 1), "d": ("cancelled", 0, None, 1)}


def test_stored_views(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lexical.write_bm25(d, "doc_id", "text", f"{tmp_path}/bm25")
    for terms in (["license", "the", "the"], ["nowhere"], []):
        key = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in x.collect())
        assert key(lexical.bm25_stored(spark, f"{tmp_path}/bm25", "doc_id", terms)) == key(lexical.bm25(d, "doc_id", "text", terms)) if terms else True
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    vectors.write_ivf(e, vectors.ivf_centroids(e), f"{tmp_path}/ivf")
    q = e.filter("vec_id = 0")
    exact = {r.vec_id for r in vectors.search(e, q, 10).collect()}
    found = [r.vec_id for r in vectors.ivf_stored(spark, f"{tmp_path}/ivf", q, 10, nprobe=16).collect()]
    assert set(found) == exact  # every list is visited
    some = vectors.ivf_stored(spark, f"{tmp_path}/ivf", q, 10, nprobe=8)
    assert {r.vec_id for r in some.collect()} == {r.vec_id for r in vectors.ivf_search(e, vectors.ivf_centroids(e), q, 10, nprobe=8).collect()} and len(exact & {r.vec_id for r in some.collect()}) >= 5


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "status.tsv").write_text("c1\tR100\tnew.py\told.py\nc1\tA\tx.py\t\n")
    changes = incremental.file_changes(repository.git_status(spark, f"{tmp_path}/status.tsv")).collect()
    assert {(r.file, r.status) for r in changes} == {("old.py", "deleted"), ("new.py", "modified"), ("x.py", "added")}
    for i, cell in enumerate([{"arm": "a", "success": True, "metrics_meaningful": True}, {"arm": "b", "success": None, "metrics_meaningful": True}, {"arm": "c", "success": True, "metrics_meaningful": False}]):
        (tmp_path / f"cell{i}.json").write_text(json.dumps(cell, indent=1))
    assert [r.arm for r in repository.load_cells(spark, f"{tmp_path}/cell*.json", "arm string, success boolean, metrics_meaningful boolean").collect()] == ["a"]
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    repository.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, repository.load_dataset(spark, f"{tmp_path}/csv", "k int, v string", "csv").collect())) == [(1, "a,b"), (2, None)]
    repository.write_view(df, f"{tmp_path}/view", "k")
    assert spark.read.parquet(f"{tmp_path}/view").filter("k = 1").first().v == "a,b"


def test_embedding_by_a_pluggable_encoder(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "alpha beta", "gamma", "", None, "  "])], "i int, t string").repartition(3)
    got = {r.i: r.embedding for r in vectors.embed(rows, "t", lambda: vectors.hashed_encoder(32), batch=1).collect()}
    assert got[0] == got[1] != got[2] and got[3] is None and got[4] is None and got[5] is None
    assert sum(x * x for x in got[2]) == pytest.approx(1) and len(got[2]) == 32


def test_request_bounds():
    from corpuscope.plans import requests

    assert requests.required_text(" x ", "query", 5) == "x" and requests.bounded_integer(3, "top_k", 20) == 3 and requests.bounded_text("", "note", 3) == ""
    for bad in ((requests.required_text, "  ", "q"), (requests.required_text, None, "q"), (requests.required_text, "abc", "q", 2), (requests.bounded_integer, True, "k", 9), (requests.bounded_integer, 0, "k", 9), (requests.bounded_integer, "3", "k", 9), (requests.bounded_text, 3, "t", 9)):
        with pytest.raises(ValueError):
            bad[0](*bad[1:])


def test_stages_need_a_weight_each(spark):
    rows = branch(spark, [(0, 1, "a", "f", 0.9, ""), (0, 2, "b", "f", 0.5, ""), (1, 1, "b", "f", 1.0, "")])
    stages = [("x", rows.filter("branch = 0")), ("y", rows.filter("branch = 1"))]
    got = lambda **more: [(r.node_id, round(r.score, 3)) for r in ranking.run_stages(stages, "node_id", 5, **more).collect()]
    assert got() == got(weights=[0.1]) == [("b", 1.5), ("a", 0.9)]
    assert got(weights=[1.0, 0.1]) == [("a", 0.9), ("b", 0.6)]
    assert [r.node_id for r in ranking.run_stages(stages[:1], "node_id", 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        ranking.run_stages([], "node_id", 3)


def test_bundles(tmp_path):
    from corpuscope.sources import bundles

    view = tmp_path / "view" / "a"
    view.mkdir(parents=True)
    (view / "x").write_bytes(b"1" * 5000)
    (tmp_path / "view" / "y").write_bytes(b"")
    one, two = (bundles.pack(str(tmp_path / "view"), str(tmp_path / n), commit="c1") for n in ("one", "two"))
    assert one == two and bundles.verify(str(tmp_path / "one"), one)["about"] == {"commit": "c1"}
    bundles.unpack(str(tmp_path / "one"), str(tmp_path / "out"), one)
    assert (tmp_path / "out" / "a" / "x").read_bytes() == b"1" * 5000 and (tmp_path / "out" / "y").exists()
    with pytest.raises(FileExistsError):
        bundles.unpack(str(tmp_path / "one"), str(tmp_path / "out"))
    damaged = (tmp_path / "one").read_bytes().replace(b"1" * 4000, b"2" * 4000)
    (tmp_path / "bad").write_bytes(damaged)
    with pytest.raises((ValueError, OSError)):
        bundles.verify(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        bundles.verify(str(tmp_path / "one"), "0" * 64)


def test_bootstraps(spark):
    rows = [(r, r * 10 + i, k, float(r + i % 3)) for r in range(6) for i in range(4) for k in range(3)]
    df = spark.createDataFrame(rows, "repo long, instance long, rep long, value double")
    b = evaluation.nested_bootstrap(df, ["repo", "instance"], "value", 100).first()
    mean = sum(x[3] for x in rows) / len(rows)
    assert b.low < mean < b.high and abs(b.mean - mean) < 0.5
    assert tuple(evaluation.nested_bootstrap(df.repartition(7), ["repo", "instance"], "value", 100).first()) == pytest.approx(tuple(b))  # but for the order of sums
    one = evaluation.bootstrap(df.filter("repo = 0"), "instance", "value", 100).first()
    assert one.low <= 0.75 <= one.high
    same = df.withColumn("value", F.lit(2.0))
    assert evaluation.nested_bootstrap(same, ["repo", "instance"], "value", 20).first()[:3] == pytest.approx((2.0, 2.0, 2.0))


def test_planner():
    both = {"sparse", "dense"}
    p = planner.select("who calls parse", {"sparse", "graph"})
    assert (p.path, p.branches, p.fusion, p.candidates) == ("structural_graph", ("sparse",), "none", 8) and p.expansion == planner.Expansion(8, 100, 2, False)
    p = planner.select("who calls parse", {"sparse", "graph", "embeddings"}, "full")
    assert p.expansion == planner.Expansion(10, 128, 2, True) and (p.rerank, p.rerank_candidates) == ("embedding", 80)
    p = planner.select("how is `foo_bar` handled", {*both, "embeddings"})
    assert (p.path, p.fusion, p.weights, p.candidates, p.rerank_candidates) == ("hybrid_fusion", "rrf", {"dense": 0.6, "sparse": 0.4}, 100, 50)
    assert planner.select("explain the behavior", both).path == "semantic"
    assert planner.select("explain", {*both, "embeddings", "model"}, "thorough").rerank == "model"
    p = planner.select("foo", both, "cheap")
    assert (p.path, p.branches, p.candidates, p.rerank) == ("fast_lexical", ("sparse",), 32, None)
    assert planner.select("who calls parse", {*both, "graph"}, "fast").expansion is None
    assert planner.select("explain this", {"sparse"}).path == "fast_lexical"
    assert planner.select("explain this", both, planner.Budget("own", 10, 0, False, False)).candidates == 10
    with pytest.raises(ValueError):
        planner.budget("other")
    with pytest.raises(ValueError):
        planner.select("x", set())


def test_plans_run(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i} gamma") for i in range(6)] + [(9, "nothing")], "id long, content string")
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    q = vecs.filter("vec_id = 5")
    e = spark.createDataFrame([(0, 2, 3, "reference", None, None), (1, 3, 9, "reference", None, None), (2, 9, 8, "reference", None, None)], "eid long, src long, dst long, type string, anchor_file string, anchor_line long")
    ids = lambda plan, query="beta2", k=10, **more: [r.id for r in planner.execute(plan, query, k, docs, vecs, q, e, **more).collect()]
    walk = planner.Plan("g", ("sparse",), "none", candidates=2, expansion=planner.Expansion(2, 4, 2, False))
    assert ids(walk) == [2, 3, 9]
    assert ids(planner.Plan("g", ("sparse",), "none", candidates=1, expansion=planner.Expansion(1, 3, 2, True)))[0] == 2
    assert ids(planner.Plan("d", ("dense",), "none", candidates=4), k=2) == [5, 4]
    assert ids(planner.Plan("s", ("sparse",), "none", candidates=6, rerank="embedding", rerank_candidates=3), "alpha") == [2, 1, 0, 3, 4, 5]
    scorer = lambda rows, query: rows.select("id", F.when(F.col("id") == 1, 9.0).alias("score")).filter("score is not null")
    assert ids(planner.Plan("s", ("sparse",), "none", candidates=6, rerank="model", rerank_candidates=3), "alpha", scorer=scorer) == [1, 0, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        ids(planner.Plan("s", ("sparse",), "none", rerank="model", rerank_candidates=3))


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity > 49").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    q = vectors.search(spark.read.parquet(f"{sf}/embeddings.parquet"), spark.read.parquet(f"{sf}/embeddings.parquet").limit(1), 3)
    assert "TakeOrderedAndProject" in q._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        lexical.identifier_occurrences(q, "not valid!")
    assert os.path.exists(sf)


def test_diff_ranges_of_all_orders(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    want = sorted((o.o_orderkey, f"f{o.o_orderkey}.py", o.o_custkey, o.o_custkey + 2) for o in orders)
    assert sorted(map(tuple, __spark_entry__.queries()["diff_ranges"](spark, sf).collect())) == want



def test_lines_of_a_reversed_region(spark):
    """A region that ends before it begins has no line, even where both lie in one interval."""
    rows = spark.createDataFrame([(1, 1, 30, 20), (1, 2, 12, 14), (1, 3, 50, 60)], "q long, rank long, s long, e long")
    cover = spark.createDataFrame([(1, 10, 40)], "q long, s long, e long")
    assert {r.rank: r.n for r in intervals.common_lines(rows, cover, ["q"], "n").collect()} == {1: 0, 2: 3, 3: 0}



def test_bm25_scores_of_equal_texts_are_equal(spark):
    """Whatever the order in which the terms of a document come."""
    terms = [("a", 0.1), ("b", 0.2), ("c", 0.3)]
    rows = [(k, t, w, 1, 1, 1.0) for k, order in ((1, terms), (2, terms[::-1]), (3, terms[1:] + terms[:1])) for t, w in order]
    hits = spark.createDataFrame(rows, "doc_id long, term string, weight double, tf long, dl long, avgdl double").coalesce(1)
    assert len({r.score for r in lexical._scored(hits, "doc_id", 1.5, 0.75).collect()}) == 1



def test_bootstrap_draws_are_not_broadcast(spark):
    """They come from a table of few rows, by which Spark takes them for a small side."""
    cells = spark.range(3000).select(F.col("id").alias("query_id"), (F.col("id") % 7).cast("double").alias("delta"), (F.col("id") % 10).alias("repo"))
    for out in (evaluation.bootstrap(cells, "query_id", "delta", 20), evaluation.nested_bootstrap(cells, ["repo", "query_id"], "delta", 4)):
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and rows[0].low <= rows[0].mean <= rows[0].high


@pytest.mark.parametrize("pairs", [50, 1 << 25])
def test_import_edges_of_files_that_share_most_symbols(spark, monkeypatch, pairs):
    """All pairs of files: they meet by blocks, and no pair is shuffled."""
    monkeypatch.setattr(facts, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(facts, "FEW_PAIRS", 0)
    rows = [(f, (f * 7 + k * 3) % 11, (f + k) % 12, k // 5 % 2) for f in range(25) for k in range(40)]
    o = spark.createDataFrame(sorted(set(rows)), "file long, start_line long, symbol long, roles int")
    spans = spark.createDataFrame([(f, 0, 3) for f in range(25)], "file long, s long, e long")
    out = facts.import_edges(spans, o, o.filter("roles = 1"))
    want = {}
    for f, line, symbol, role in set(rows):
        for g, _, other, definition in set(rows) if role == 0 and line <= 3 else ():
            if definition == 1 and other == symbol and g != f:
                want[f, g] = min(line, want.get((f, g), line))
    assert sorted((r.source, r.target, r.anchor_line) for r in out.collect()) == sorted((*k, v) for k, v in want.items())
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_distinct_rows_are_dealt_out_by_the_size_of_the_table(spark, sf, monkeypatch):
    from corpuscope import session
    from corpuscope.plans import views

    monkeypatch.setattr(session, "PART_INPUT", 1 << 12)
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    out = session.distinct(line)
    assert out.rdd.getNumPartitions() == -(-session.size_of(line) // (1 << 12)) > 4
    assert out.count() == line.distinct().count()
    plan = views.edges(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3


def test_staged_edges_meet_the_known_ones_in_one_exchange(spark):
    staged = spark.createDataFrame([(1, 2, None, 5), (1, 2, None, 3), (1, 3, 7, 4), (2, 2, None, 9)], "src long, dst long, at long, eid long")
    known = spark.createDataFrame([(1, 3, 7), (2, 2, 1)], "src long, dst long, at long")
    out = incremental.stage_edges(known, staged, ["src", "dst", "at"], "eid")
    assert sorted((r.src, r.dst, r.at is None, r.eid) for r in out.collect()) == [(1, 2, True, 3), (2, 2, True, 9)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_layers_count_a_node_in_one_pass(spark):
    e = spark.createDataFrame([(1, 1, 2, "contain"), (2, 2, 3, "import"), (3, 2, 3, "import"), (4, 4, 4, "other")], "eid long, src long, dst long, type string")
    out = graph.layer_summary(e)
    assert sorted(map(tuple, out.collect())) == [("all", 4, 4), ("containment", 1, 2), ("dependency", 2, 2), ("import", 2, 2)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_edges_are_read_once_for_all_levels(spark):
    """A path that is sought both ways, and a neighbourhood, make their steps once."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "long")
    rows = spark.createDataFrame([(i, i, i + 1, "reference") for i in range(6)], "eid long, src long, dst long, type string")
    rows = rows.withColumn("src", count("src"))
    assert [r.vid for r in graph.trace(rows, 3, 1, 3).orderBy("step").collect()] == [3, 2, 1]
    assert seen.value <= 6
    assert {r.vid: r.depth for r in graph.bfs(rows, spark.createDataFrame([(3,)], "vid long"), 2, "both").collect()} == {3: 0, 2: 1, 4: 1, 1: 2, 5: 2}
    assert seen.value <= 12


def test_postings_are_counted_where_the_texts_are(spark):
    """Not one row a token is shuffled; rows that repeat a key count together."""
    d = spark.createDataFrame([(1, "a b a"), (2, "b"), (1, "a c")], "doc_id long, text string")
    out = lexical.postings(d, "doc_id", "text")
    assert sorted((r.doc_id, r.term, r.tf) for r in out.collect()) == [(1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "b", 1)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.index("Generate explode") < plan.index("Exchange ")


def test_points_meet_spans_in_parts_by_the_size_of_the_tables(spark, sf, monkeypatch):
    from corpuscope import session
    from corpuscope.plans import views

    monkeypatch.setattr(session, "PART_INPUT", 1 << 13)
    p, x = views.points(spark, sf), views.spans(spark, sf)
    plan = intervals.innermost(p, x, "file", "line", "s", "e", "event_id", "id")._jdf.queryExecution().optimizedPlan().toString()
    n = session.parts(p, x)
    assert n > 4 and plan.count(f"__bucket#") and plan.count(f", {n}\n") == 2
