"""Upkeep, changes, keyword index, search results and grounding against worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knotwork.operators import changes as CH
from knotwork.operators import grounding as GR
from knotwork.operators import hybrid as HY
from knotwork.operators import keywords as K
from knotwork.operators import suggest as SG
from knotwork.operators import upkeep as U
from knotwork.scratch import shared_dir

def now():
    return F.to_timestamp_ntz(F.lit("2026-01-10 00:00:00"))


def rows(df):
    return {tuple(r) for r in df.collect()}


# keywords


def test_terms_of_all_scripts_without_accents(spark):
    text = "Café ΚΎΚΛΟΣ, Ёлка-naïve 概念です हिन्दी x_1"
    want = ["cafe", "κυκλοσ", "елка", "naive", "概念です", "हिन्दी", "x", "1"]
    assert spark.range(1).select(K.tokens(F.lit(text))).first()[0] == want == K.query_tokens(text)
    assert spark.range(1).select(K.tokens(F.lit(None).cast("string"))).first()[0] == [] and K.query_tokens("...") == []


def test_index_ranks_batches_and_empty_questions(spark):
    texts = [("d0", "common alpha"), ("d1", "common beta beta"), ("d2", None), ("d3", "common alpha gamma delta"), ("d4", "ALPHA")]
    df = spark.createDataFrame(texts, "id string, text string")
    whole = K.build_index(spark, df, "id", "text")
    grown = K.added(spark, K.build_index(spark, df.limit(3), "id", "text"), df.where("id in ('d3', 'd4')"), "text")
    for terms in (["alpha"], ["common"], ["alpha", "beta", "alpha"]):
        a, b = ({r["id"]: round(r["rank"], 9) for r in i.search(terms).collect()} for i in (whole, grown))
        assert a == b and a
    idf = __import__("math").log((5 - 1 + 0.5) / (1 + 0.5))
    assert whole.search(["beta"]).first()["rank"] == pytest.approx(-idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)))
    assert whole.search([]).count() == 0 and whole.search(["absent"]).count() == 0
    assert K.build_index(spark, df.limit(0), "id", "text").search(["alpha"]).count() == 0


def test_equal_ranks_newest_first(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    df = spark.createDataFrame([("a", 1.0, t(1)), ("b", 1.0, t(2)), ("c", 1.0, None), ("d", 0.5, t(1))], "id string, rank double, at timestamp_ntz")
    assert [(r["id"], r["pos"]) for r in K.newest_first(df, F.col("rank"), "at", "id", 4).orderBy("pos").collect()] == [("d", 0), ("b", 1), ("a", 2), ("c", 3)]


# results


def test_results_with_content_and_warnings(spark):
    schema = "id string, fl_type string, title string, concept_id string, content string, path string, line_start int, line_end int, language string, residual double, staleness double"
    chunks = spark.createDataFrame([("s", "source", "fn", None, "body", "a.ts", 3, 4, "ts", None, None), ("d", "doc", "x.md", None, "y" * 5000, "x.md", None, None, None, None, None), ("c", "chunk", "auth", "k", "text", None, None, None, None, 0.9, 0.6), ("e", "chunk", "auth", "k2", None, None, None, None, None, 0.6, None)], schema)
    res = spark.createDataFrame([(i, k, 1.0) for i, k in enumerate("sdcex")], "pos int, id string, score double")
    sym = spark.createDataFrame([(f"y{i}", "f", f"q{i}", 1, 2, None if i == 6 else f"b{i}") for i in range(8)], "symbol_id string, source_file_id string, qualified_name string, line_start int, line_end int, body string")
    bind = spark.createDataFrame([("k", f"y{i}", i / 10) for i in range(8)], "concept_id string, symbol_id string, confidence double")
    files = spark.createDataFrame([("f", "p.go", "go")], "source_file_id string, file_path string, language string")
    bodies = HY.symbol_bodies(chunks.where("concept_id is not null"), bind, sym, files)
    got = {r["id"]: r for r in HY.hydrated(res, chunks, bodies).collect()}
    assert got["s"]["content"] == "[Source: a.ts:3-4]\n```ts\nbody\n```" and got["d"]["content"] == "[Doc: x.md]\n" + "y" * 4000
    assert got["c"]["warning"] == HY.STALE_WARNING and got["e"]["warning"] == HY.RESIDUAL_WARNING and got["s"]["warning"] is None and "x" not in got
    assert got["c"]["content"].startswith("text\n\n[Symbol: q7 (p.go:1-2)]\n```go\nb7\n```") and got["c"]["content"].count("[Symbol") == 4 and got["e"]["content"] == ""


def test_next_actions(spark):
    r = lambda data: spark.createDataFrame(data, "pos int, concept string, warning string, staleness double")
    trail = spark.createDataFrame([("n",)], "narrative string")
    act = lambda data, t: [(a["kind"], a["target"]) for a in HY.next_actions(r(data), HY.stale_signals(r(data)), t).orderBy("place").collect()]
    assert act([(0, "a", None, 0.1)], trail) == [("show", "a"), ("recall", None), ("trail", "n")] and act([], trail.union(trail)) == [("ingest", None), ("recall", None)]
    assert HY.stale_signals(r([(0, "a", None, 0.5)])).first()[0] and not HY.stale_signals(r([(0, "a", None, 0.4)])).first()[0] and HY.stale_signals(r([(0, "a", "w", None)])).first()[0]
    claims = spark.createDataFrame([(0.9,)], "max_staleness double")
    assert HY.stale_signals(r([]), None, claims).first()[0]


# upkeep


def test_weighted_centroids_and_ground(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 3.0), ("a", [0.0, 1.0], 1.0), ("b", [1.0, 0.0], 0.0), ("b", [0.0, 1.0], None)], "id string, vec array<double>, w double")
    assert {r["id"]: r["centroid"] for r in U.weighted_centroids(v, "id", "vec", "w").collect()} == {"a": [0.75, 0.25], "b": [0.5, 0.5]}
    c = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7)], "id string, churn double")
    code, text = v.where("id = 'a'").limit(1).select("id", "vec"), spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "id string, vec array<double>")
    s = spark.createDataFrame([("a", 1.0, [1.0, 0.0], None), ("b", 1.0, None, [0.0, 2.0])], "id string, confidence double, code array<double>, text array<double>")
    assert rows(U.ground_residuals(c, code, text, s)) == {("a", 0.0, "code"), ("b", 1.0, "text"), ("c", 0.7, "churn")}


def test_names_discovery_and_edges(spark):
    m = spark.createDataFrame([(1, "auth-token-cache"), (1, "auth_cache"), (1, "auth io"), (2, "x"), (2, None)], "c int, name string")
    assert {(r["c"], r["n"], r["domain"]) for r in U.cluster_names(m, "c", "name").collect()} == {(1, 3, "auth, cache"), (2, 2, "mixed")}
    ch = spark.createDataFrame([("p", 1, "auth-a", [1.0, 0.0]), ("q", 1, "auth-b", [0.9, 0.1]), ("r", 1, "auth-c", [0.0, 1.0]), ("s", 2, "z", [1.0, 0.0]), ("t", None, "z", [1.0, 0.0])], "chunk_id string, cluster int, title string, vec array<double>")
    got = U.discovered(ch, spark.createDataFrame([("s",)], "active_chunk_id string")).collect()
    assert [(r["cluster"], r["name"], r["active_chunk_id"], r["n_chunks"]) for r in got] == [(1, "auth", "q", 3)]
    e = U.cluster_edges(ch).collect()
    assert [(r["a"], r["b"]) for r in e] == [(1, 2)] and e[0]["alpha"] == pytest.approx((1 + 0.9 / 0.82**0.5) / 3)


def test_heal_run_stops(spark):
    c = spark.createDataFrame([("a", 0.9, 0.8, 0.9), ("b", 0.7, 0.1, 0.7), ("c", 0.5, 0.5, 0.5)], "id string, staleness double, residual double, final_stale double")
    got = {r["id"]: r for r in U.heal_run(c, 10.0, 0.0).collect()}
    assert set(got) == {"a", "b"} and got["a"]["status"] == "healed" and got["a"]["debt_after"] == pytest.approx(10 - 0.345) and got["b"]["residual_after"] == 0
    stopped = {r["id"]: r["status"] for r in U.heal_run(c, 10.0, 0.0, stop=-0.2).collect()}
    assert stopped == {"a": "healed", "b": "healed"} or stopped["b"] == "healed"
    assert [r["status"] for r in U.heal_run(c, 10.0, 0.0, stop=-0.5).orderBy("pos").collect()] == ["healed", "halted"]


def test_runs_reports_and_guards(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    s = spark.createDataFrame([("r1", t(1), "a", 0.9), ("r2", t(2), "a", 0.2), ("r2", t(2), "gone", 0.3)], "run string, created_at timestamp_ntz, id string, final_stale double")
    c = spark.createDataFrame([("a", "A")], "id string, name string")
    assert U.latest_run(s).first()["run"] == "r2" and [(r["id"], r["final_stale"]) for r in U.latest_signals(s, c, 5).collect()] == [("a", 0.2)]
    assert U.latest_run(s.limit(0)).count() == 0
    m, q = spark.createDataFrame([(1,)], "graph_stale int"), spark.createDataFrame([("done",)], "status string")
    assert U.needs_refresh(m, q).first()["refresh"] and not U.needs_refresh(m, q.union(spark.createDataFrame([("leased",)], "status string"))).first()["refresh"]
    assert rows(U.manifest_health(spark.createDataFrame([(25.0,), (10.0,), (9.9,)], "debt double"))) == {(25.0, "critical"), (10.0, "degrading"), (9.9, "healthy")}
    assert rows(U.edges_of_latest(spark.createDataFrame([("a", 1), ("b", 2)], "e string, v int"), "v")) == {("b", 2)}


def test_neighbours_from_both_sides(spark):
    r = spark.createDataFrame([("a", "b", 0.5, 1), ("c", "a", 0.9, 1), ("a", "a", 0.1, 1), ("a", "x", 1.0, 1), ("b", "c", 1.0, 0)], "from_id string, to_id string, weight double, active int")
    c = spark.createDataFrame([(k, k.upper()) for k in "abc"], "id string, name string")
    f = spark.createDataFrame([("b", 0.3)], "id string, final_stale double")
    got = [(x["concept"], x["direction"], x["final_stale"]) for x in U.health_neighbors(r, c, f).where("id = 'a'").orderBy("pos").collect()]
    assert got == [("C", "inbound", None), ("B", "outbound", 0.3), ("A", "outbound", None)]


def test_suggestions_of_narratives_and_reducers(spark):
    old, new = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 9)
    n = spark.createDataFrame([("a", "closing", new, 0), ("b", "open", old, 2), ("c", "open", old, 0), ("d", "open", new, 0), ("e", "closed", old, 1), ("f", "close_failed", new, 1)], "id string, status string, opened_at timestamp_ntz, entry_count int")
    assert {(r["id"], r["kind"]) for r in SG.narratives_to_settle(n, now()).collect()} == {("a", "close-narrative"), ("b", "close-narrative"), ("c", "abandon-narrative"), ("f", "close-narrative")}
    s = spark.createDataFrame([("x", "review", 0.9, 0), ("y", "review", 0.8, 0), ("z", "other", 0.7, 1)], "id string, kind string, confidence double, priority int")
    p = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 9.0)], "id string, pressure double")
    top = SG.debt_reducers(SG.with_impact(s, p, {"review": 0.5}, 0.0, 10.0, 20.0), 20.0).orderBy("pos").collect()
    assert [(r["id"], r["reduction"], r["debt_left"]) for r in top] == [("y", 2.0, 18.0), ("x", 1.0, 17.0)]
    assert SG.of_kinds(s, ["other"]).count() == 1 and SG.of_kinds(s, None).count() == 3


# changes

CONCEPTS = "id string, name string, lifecycle_status string, lifecycle_reason string, archived_at timestamp_ntz, merged_into_concept_id string, inserted_at timestamp_ntz"


def test_lifecycle(spark):
    c = spark.createDataFrame([("a", "A", None, None, None, None, None), ("b", "B", "active", None, None, None, None), ("c", "C", "archived", "old", None, None, None)], CONCEPTS)
    ids = spark.createDataFrame([("a",), ("c",), ("a",), ("none",)], "id string")
    assert [(r["id"], r["lifecycle_status"]) for r in CH.archived(c, ids, F.lit("r"), now()).collect()] == [("a", "archived")]
    assert [(r["id"], r["lifecycle_status"], r["lifecycle_reason"]) for r in CH.restored(c, ids).collect()] == [("c", "active", None)]
    m = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c"), ("b", "none"), ("c", "a")], "from_id string, to_id string")
    assert [(r["id"], r["merged_into_concept_id"]) for r in CH.merged_into(c, m, now()).collect()] == [("a", "b")]
    b = spark.createDataFrame([("a", "s", 0.4), ("b", "s", 0.9), ("a", "t", 0.1)], "concept_id string, symbol_id string, confidence double")
    assert rows(CH.rebound(b, m.limit(1))) == {("b", "s", 0.9), ("b", "t", 0.1)}
    parts = spark.createDataFrame([("a", "a2", "part"), ("none", "n2", "x")], "from_id string, new_id string, name string")
    assert [(r["id"], r["name"], r["lifecycle_reason"]) for r in CH.split_off(c, parts, now()).collect()] == [("a2", "part", "split from a")]
    e = spark.createDataFrame([("e1", "n", ["x"]), ("e2", "n", ["y"])], "entry_id string, narrative string, concepts array<string>")
    d = spark.createDataFrame([("e1", "n", ["q", "p", "q"]), ("e9", "n", ["z"])], "entry_id string, narrative string, concepts array<string>")
    assert {(r["entry_id"], tuple(r["concepts"]), r["designated"]) for r in CH.designated(e, d).collect()} == {("e1", ("p", "q"), True), ("e2", ("y",), False)}


def test_ancestry_follows_parents(spark):
    c = spark.createDataFrame([("c1", None), ("c2", "c1"), ("c3", "c2"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    h = spark.createDataFrame([("c3",), ("c2",), ("x",)], "id string")
    assert rows(CH.ancestry(c, h, 2)) == {("c3", 0, "c3"), ("c3", 1, "c2"), ("c2", 0, "c2"), ("c2", 1, "c1")}


def test_patches(spark):
    text = "one\n\ntwo\n\nthree"
    ops = CH.parse_ops('so: [{"op": "delete", "block_id": "block-1"}, {"op": "insert_after", "block_id": "block-2", "content": "new"}, {"op": "append", "content": "end"}]')
    assert CH.apply_ops(text, ops) == "two\n\nnew\n\nthree\n\nend"
    assert CH.parse_ops('[{"op": "replace", "block_id": "b"}]') is None and CH.parse_ops("none") is None and CH.parse_ops('[{"op": "x"}]') is None and CH.parse_ops("[1") is None
    assert CH.apply_ops(text, [{"op": "delete", "block_id": "block-9"}]) is None and CH.apply_ops("a", [{"op": "delete", "block_id": "block-1"}]) is None
    df = spark.createDataFrame([(1, text, "[]", None), (2, text, "bad", "re"), (3, None, None, None)], "id int, content string, ops string, rewrite string")
    assert {(r["id"], r["content"], r["way"]) for r in CH.patched(df, "id").collect()} == {(1, text, "patch"), (2, "re", "rewrite"), (3, None, "kept")}


def test_rescans(spark):
    s, f = (spark.createDataFrame(x, "file_path string, digest string") for x in ([("a", "1"), ("b", "1"), ("c", None)], [("b", "2"), ("c", None), ("d", "1")]))
    assert rows(CH.rescan(s, f)) == {("a", "remove"), ("b", "change"), ("c", "skip"), ("d", "add")}
    assert rows(CH.rescan(s, f, s.where("file_path = 'b'"))) == {("b", "change")}
    b = spark.createDataFrame([("c", "o1", "t", 0.5), ("c", "o2", "t", 0.9), ("c", "o3", "t", 0.9)], "concept_id string, symbol_id string, binding_type string, confidence double")
    old = spark.createDataFrame([("o1", "f", "x"), ("o2", "f", "x"), ("o3", "f", None)], "symbol_id string, source_file_id string, qualified_name string")
    new = spark.createDataFrame([("n", "f", "x", "h"), ("m", "g", "x", "h")], "symbol_id string, source_file_id string, qualified_name string, body_hash string")
    assert rows(CH.reattached(b, old, new)) == {("c", "n", "t", 0.9, "h", "o2")}


def test_upserted_relations_and_cache(spark):
    schema = "from_id int, to_id int, relation_type string, weight double, active int, at long"
    old = spark.createDataFrame([(1, 2, "t", 0.5, 0, 9)], schema)
    new = spark.createDataFrame([(1, 2, "t", float("nan"), 0, 1), (1, 3, "t", 7.0, 1, 1), (1, 3, "t", -1.0, 1, 2)], schema)
    assert rows(CH.relations_upserted(old, new).drop("at")) == {(1, 2, "t", 1.0, 1), (1, 3, "t", 0.0, 1)}
    t = lambda d: dt.datetime(2026, 1, d)
    empty = spark.createDataFrame([], "id string, query_text string, result_json string, created_at timestamp_ntz, expires_at timestamp_ntz, score double, scored_by string")
    put = CH.cache_put(empty, spark.createDataFrame([("a", "q", "{}", t(1), t(5)), ("b", "q", "{}", t(1), None)], "id string, query_text string, result_json string, created_at timestamp_ntz, expires_at timestamp_ntz"))
    assert CH.cache_put(put, put.drop("score", "scored_by")).count() == 2
    sc = CH.cache_scored(put, spark.createDataFrame([("b", 0.5, None, t(2)), ("b", 0.1, "me", t(1)), ("z", 1.0, None, t(1))], "id string, score double, scored_by string, at timestamp_ntz"))
    assert {(r["id"], r["score"], r["scored_by"]) for r in sc.collect()} == {("a", None, None), ("b", 0.5, "agent")}
    assert [r["id"] for r in CH.cache_pruned(sc, now()).collect()] == ["b"]


def test_work_ends_and_survives_faults():
    jobs, said, waits = [3, None, 0, None, None], [], []
    done = CH.work(lambda: jobs.pop(0) if jobs else None, lambda j: 1 / j, poll_ms=1, max_idle=2, tell=lambda s, j: said.append((s, j)), sleep=waits.append)
    assert done == {"handled": 1, "failed": 1, "idle": 3} and said == [("handled", 3), ("failed: ZeroDivisionError", 0)] and set(waits) == {0.05}
    assert CH.work(lambda: 1, lambda j: None, max_jobs=2)["handled"] == 2


def test_trace_and_sites(spark, tmp_path):
    CH.write_trace(spark.createDataFrame([("q", dt.datetime(2026, 1, 2))], "event string, at timestamp_ntz"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).select("event", F.col("day").cast("string")).first() == ("q", "2026-01-02")
    s = spark.createDataFrame([("f", 1, "a", "b", "y"), ("f", 1, "a", "b", "x"), ("f", 2, "a", "b", None)], "file string, line int, caller string, callee string, snippet string")
    assert rows(CH.unique_sites(s)) == {("f", 1, "a", "b", "x"), ("f", 2, "a", "b", None)}


# grounding


def test_hints_and_claims(spark):
    m = spark.createDataFrame([(0, "auth cache", "db story", "The cache cache of 42 tokens"), (1, "auth", None, None)], "pos int, concept string, origin string, content string")
    got = {r["term"]: r["score"] for r in GR.summary_hints(m, "what about tokens?", 9).collect()}
    assert got == {"auth": 2 * 3 + 3, "cache": 2 * 3 + 2, "db": 4, "story": 4}
    t = spark.createDataFrame([(1, "Plain.\nIt holds [a.ts:12] here [[x, y]]"), (2, None)], "id int, text string")
    assert [(r["id"], r["line"], r["claim"], r["concepts"]) for r in GR.claims(t, "id", "text").collect()] == [(1, 2, "It holds here", ["x", "y"])]


def test_evidence(spark):
    m = spark.createDataFrame([(0, "c"), (1, "d")], "pos int, concept_id string")
    b = spark.createDataFrame([("c", "s1", 0.5), ("c", "s2", 0.9), ("d", "s1", 1.0), ("d", "s3", None)], "concept_id string, symbol_id string, confidence double")
    s = spark.createDataFrame([("s1", "f1", "p", 1), ("s2", "f2", "p", 9), ("s3", "f3", "p", 9)], "symbol_id string, name string, file_path string, line_start int")
    assert [(r["pos"], r["line"], r["term"]) for r in GR.symbol_evidence(m, b, s).orderBy("pos").collect()] == [(0, 9, "f2"), (1, 1, "f1")]
    sites = spark.createDataFrame([("a", "f", "x", 1), ("b", "f", "x", 5), ("f", "g", "x", 300), ("z", "y", "x", 1)], "caller string, callee string, file string, line int")
    got = {(r["first_line"], r["sites"]) for r in GR.call_evidence(spark.createDataFrame([("f",)], "name string"), sites).collect()}
    assert got == {(1, 2), (300, 1)}


def test_no_local_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_symbols_of_nested_code():
    from knotwork.sources import code as SC

    ts = "export class Cache<T> {\n  private async load(key: string): Promise<void> {\n    if (key) {\n      run(key);\n    }\n  }\n}\nexport const pick = (x) => x;\n"
    got = {s["qualified_name"]: (s["kind"], s["parent"], s["line_start"], s["line_end"]) for s in SC.symbols_of(ts, "typescript")}
    assert got == {"Cache": ("class", None, 1, 7), "Cache.load": ("method", "Cache", 2, 6), "pick": ("function", None, 8, 8)}
    ex = "defmodule A.B do\n  defmacro wrap(x) do\n    x\n  end\n  defp go?(y), do: y\nend\ndefprotocol P do\n  def size(d)\nend\n"
    assert [(s["qualified_name"], s["kind"]) for s in SC.symbols_of(ex, "elixir")] == [("A.B", "class"), ("A.B.wrap", "function"), ("A.B.go?", "function"), ("P", "interface"), ("P.size", "function")]
    known = {"src/a.ts", "src/lib/index.ts", "pkg/__init__.py"}
    assert SC.existing_path("src/a.js", known, "typescript") == "src/a.ts" and SC.existing_path("src/lib", known, "typescript") == "src/lib/index.ts"
    assert SC.existing_path("pkg", known, "python") == "pkg/__init__.py" and SC.existing_path("src/none", known, "typescript") is None


def test_call_graph_visits_limit_the_way_on(spark):
    from knotwork.operators import graph as G

    sites = spark.createDataFrame([("a", "s", "f", 1, "x"), ("s", "a", "f", 2, "y"), ("b", "a", "f", 3, "z"), ("a", "a", "f", 4, "r"), (None, "s", "f", 5, "n")], "caller string, callee string, file string, line int, snippet string")
    got = rows(G.call_graph(sites, spark.createDataFrame([("s",), ("s",)], "name string")).select("direction", "depth", "name", "other", "snippet"))
    assert got == {("up", 0, "s", "a", "x"), ("up", 1, "a", "s", None), ("up", 1, "a", "b", None), ("up", 1, "a", "a", None), ("down", 0, "s", "a", "y"), ("down", 1, "a", "s", None), ("down", 1, "a", "a", None)}
