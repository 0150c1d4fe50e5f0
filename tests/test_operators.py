"""Operators of the survey against worked examples and invariants."""

import datetime as dt

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from knotwork.functions import scalars as S
from knotwork.operators import coverage as C
from knotwork.operators import graph as G
from knotwork.operators import health as H
from knotwork.operators import interactions as I
from knotwork.operators import queues as Q
from knotwork.operators import retrieval as R
from knotwork.operators import suggest as SG
from knotwork.operators import texts as T
from knotwork.operators import versioning as VS
from knotwork.operators import views as V
from knotwork.plans.mapping import terms_of
from knotwork.sources import chunks as SC
from knotwork.sources import code as CODE
from knotwork.streaming import interactions as ST

DAY = dt.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("computeStaleness", "computeStaleness compute staleness"), ("parseJSON", "parseJSON parse j s o n"), ("Auth model", "Auth model"), ("HTTPServer", "HTTPServer h t p server"), ("", "")])
def test_camel(spark, text, want):
    assert one(spark, S.expand_camel(F.lit(text))) == want


def test_terms_agree(spark):
    text = "Which parseJSON of auth-model Café?"
    assert one(spark, S.query_terms(F.lit(text))) == terms_of(text)


def test_small_functions(spark):
    lit = F.lit
    assert one(spark, S.fts_query(lit("open (now)"))) == '"open" OR "now"' and one(spark, S.fts_query(lit("  "))) == '""'
    assert one(spark, S.slug(lit("  Auth & Model! "))) == "auth-model"
    assert [one(spark, S.journal_status(lit(t))) for t in ("it failed", "is it? ", "we verified it", "note")] == ["dead-end", "question", "confirmed", "finding"]
    assert one(spark, S.compact(lit("a\n b\tc  d"), 20)) == "a b c d" and one(spark, S.compact(lit("abcdef ghij"), 6)) == "abcde…"
    assert [one(spark, S.directory(lit(p))) for p in ("a/b/c.ts", "a/b.ts", "a.ts")] == ["a/b", "a", "a.ts"]
    assert one(spark, S.name_variants(lit("Mod.Sub#run"))) == ["Mod.Sub#run", "run"]
    assert one(spark, S.lines_between(lit("a\nb\nc"), lit(2), lit(9))) == "b\nc" and one(spark, S.lines_between(lit("a"), lit(4), lit(9))) is None
    assert one(spark, S.excerpts(lit("no\n\nthe cache path\n\ncache"), lit("cache path"), 1)) == ["the cache path"]
    assert one(spark, S.attributions(lit("x [[a, b]] y [[b]]"))) == ["a", "b"]
    assert one(spark, S.clamp(lit(float("nan")))) == 0 and one(spark, S.clamp(lit(7.0))) == 1 and one(spark, S.clamp(lit(None))) == 0
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, S.cosine(v(1.0, 0.0), v(0.0, 0.0))) == 0 and one(spark, S.cosine_distance(v(1.0, 0.0), v(-1.0, 0.0))) == 2
    assert one(spark, S.is_deep_query(lit("how does it lead to that"))) and not one(spark, S.is_deep_query(lit("plain")))
    assert one(spark, S.wants_exact(lit("see a/b.ts"))) and not one(spark, S.wants_exact(lit("plain")))


def test_bm25_formula(spark):
    docs = ["open concept content auth model", "archived concept content", "identity model snapshot of the auth-model cache_layer", "caf content content", "the the the common", "common x", "common y concept"]
    df = spark.createDataFrame([*enumerate(docs)], "id int, text string")
    got = {r["id"]: r["rank"] for r in R.bm25(df, "id", "text", ["content", "model"]).collect()}
    n, lens = len(docs), [len(terms_of_doc(d)) for d in docs]
    for i, d in enumerate(docs):
        want = 0.0
        for q in ("content", "model"):
            df_q, tf = sum(q in terms_of_doc(x) for x in docs), terms_of_doc(d).count(q)
            idf = np.log((n - df_q + 0.5) / (df_q + 0.5))
            want -= (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[i] / np.mean(lens)))
        assert got.get(i, 0.0) == pytest.approx(want)
    assert R.bm25(df, "id", "text", []).count() == 0


def terms_of_doc(text):
    return [w for w in __import__("re").split("[^a-z0-9]+", text.lower()) if w]


def test_fusions(spark):
    lane = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, pos int")
    got = {r["id"]: r["score"] for r in R.rrf({"x": (lane(["a", "b"]), 1.0), "y": (lane(["b", "c"]), 1.0)}, "id", 10).collect()}
    assert got == pytest.approx({"a": 1 / 10, "b": 1 / 11 + 1 / 10, "c": 1 / 11})
    text = spark.createDataFrame([("x", 0.30), ("y", 0.10)], "id string, distance double")
    words = lane(["z", "x"]).withColumn("distance", R.keyword_distance(F.col("pos")))
    got = {r["id"]: r["score"] for r in R.merge_by_distance([text, words], "id").collect()}
    assert got == pytest.approx({"z": 1.0, "x": 1 - 1 / 31, "y": 0.9})


def test_penalty_dedupe_boost_trail(spark):
    assert one(spark, R.staleness_penalty(F.lit(0.8), F.lit(99.0), 47, 1.5)) == pytest.approx(0.68)
    assert one(spark, R.staleness_penalty(F.lit(0.8), F.lit(23.5), 47, 1.0)) == pytest.approx(0.76)
    rows = spark.createDataFrame([("k1", "A", 0.5, 0), ("k2", None, 0.4, 1), ("k3", "A", 0.9, 2), ("k4", None, 0.1, 3)], "id string, concept string, score double, pos int")
    assert {(r["id"], r["slot"]) for r in R.best_per_concept(rows, "concept", "id").collect()} == {("k3", 0), ("k2", 1), ("k4", 3)}
    boosted = R.structural_boost(rows.where("concept is not null").select("concept", "score").limit(1), spark.createDataFrame([("A", 0.4), ("A", 0.8), ("B", 1.0)], "concept string, confidence double"), "concept")
    assert {(r["concept"], round(r["score"], 6), r["injected"]) for r in boosted.collect()} == {("A", 0.54, False), ("B", round(1 / 61 + 0.05, 6), True)}
    trail = R.journal_trail(spark.createDataFrame([("n", f"e{i}", i / 10) for i in range(6)] + [("m", "z", 0.001)], "narrative string, id string, score double"), "narrative", "id")
    assert {r["id"] for r in trail.collect()} == {"e5", "e4", "e3"}


def test_claims(spark):
    c = spark.createDataFrame([("p", "a"), ("p", "x"), ("q", "a")], "claim string, source string")
    s = spark.createDataFrame([("a", 1.0, 0.5)], "source string, freshness double, relevance double")
    got = {r["claim"]: r["confidence"] for r in R.claim_confidence(c, s, "claim", "source").collect()}
    assert got == pytest.approx({"p": 0.4 * 0.75 + 0.4 * 0.5 + 0.2 * 2 / 3, "q": 0.4 + 0.2 + 0.2 / 3})


def test_pagerank(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 1.0), ("c", "b", 0.5)], "source string, target string, weight double")
    seed = spark.createDataFrame([("a",)], "node string")
    got = {r["node"]: r["score"] for r in G.personalized_pagerank(spark, e, seed).collect()}
    assert got == pytest.approx({"a": 0.310332116, "b": 0.369003652, "c": 0.320664232}, abs=1e-8)
    lost = {r["node"]: r["score"] for r in G.personalized_pagerank(spark, e.limit(1), seed).collect()}
    assert lost == pytest.approx({"a": 0.15, "b": 0.1275})
    assert G.personalized_pagerank(spark, e, seed.limit(0)).count() == 0


def test_spectra(spark):
    m = np.array([[1, 0.8, 0.7], [0.8, 1, 0.75], [0.7, 0.75, 1]])
    assert np.linalg.eigvalsh(G.laplacian(m)) == pytest.approx([0, 2.163397, 2.336603], abs=1e-6) and G.fiedler(m) == pytest.approx(2.163397, abs=1e-6)
    assert G.fiedler(np.zeros((1, 1))) == 0
    for sizes in ([4, 3, 3], [5, 5]):
        n, label = sum(sizes), np.repeat(range(len(sizes)), sizes)
        block = np.where(label[:, None] == label[None, :], 0.9, 0.0)
        got = G.spectral_labels(block)
        assert {frozenset(np.flatnonzero(got == v)) for v in set(got)} == {frozenset(np.flatnonzero(label == k)) for k in range(len(sizes))} and n == len(got)
    path = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5)], "a string, b string, weight double")
    assert {r["node"]: r["degree"] for r in G.degrees(path).collect()} == {"a": 0.5, "b": 1.0, "c": 0.5}


def test_relations(spark):
    r = spark.createDataFrame([(1, 2, 0.5, 1), (2, 3, 0.4, 1), (3, 4, 1.0, 1), (1, 1, 1.0, 1), (1, 4, 1.0, 0), (2, 1, 0.7, 1)], "from_id int, to_id int, weight double, active int")
    got = {(x["node"], x["target"]): (x["via"], round(x["weight"], 6)) for x in G.two_hop(r).collect()}
    assert got[1, 3] == (2, 0.28) and got[2, 4] == (3, 0.4) and (1, 4) not in got
    assert {(x["a"], x["b"], x["weight"]) for x in G.relation_matrix(r).collect()} == {(1, 2, 0.7), (2, 3, 0.4), (3, 4, 1.0), (1, 4, 1.0)}
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "source string, target string, weight double")
    assert {(x["node"], x["hop"]) for x in G.expand(e, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_health_worked_example(spark):
    c = spark.createDataFrame([("c1", "alpha", 0.2, None, False, None, None, None), ("c2", "beta", 0.8, 0.7, True, None, None, None)], "id string, name string, staleness double, drift double, critical boolean, ground_residual double, churn double, lore_residual double")
    rel = spark.createDataFrame([("c1", "c2", 1.0, 1)], "from_id string, to_id string, weight double, active int")
    got = {r["id"]: r for r in H.health_signals(c, rel, 0.4, 0.2).collect()}
    assert got["c1"]["local_graph_stale"] == pytest.approx(0.76) and got["c1"]["global_shock"] == pytest.approx(0.475) and got["c1"]["influence"] == pytest.approx(0.1) and got["c1"]["final_stale"] == pytest.approx(0.2745)
    assert got["c1"]["residual_after"] == pytest.approx(0.205875)
    assert got["c2"]["local_graph_stale"] == pytest.approx(0.12) and got["c2"]["final_stale"] == pytest.approx(0.773775) and got["c2"]["residual_after"] == pytest.approx(0.7834471875)
    assert got["c1"]["debt_after"] == pytest.approx(0.6 * 0.9 * (0.2745 + 0.773775) / 1.2)
    a, b = H.heal(F.lit(0.9), F.lit(0.7), F.lit(0.8))
    assert one(spark, a) == pytest.approx(0.46) and one(spark, b) == pytest.approx(0.38)


def test_debt(spark):
    c = spark.createDataFrame([("x", 3.0, None, None)], "id string, ground_residual double, churn double, lore_residual double")
    for fiedler, want in ((0, 1.8), (1, 0.9), (5, 0.3)):
        assert H.total_debt(c, fiedler).first()["debt"] == pytest.approx(want)
    assert [one(spark, H.debt_trend(F.lit(x), F.lit(10.0))) for x in (11.0, 9.0, 10.4, 10.5)] == ["degrading", "improving", "stable", "stable"]
    parts = dict(zip(H.ASK_WEIGHTS, (0.5, 0.2, 0.1, 0.0, 0.4, 0.0, 0.25, 0.3)))
    r = H.ask_debt(spark.range(1).select(*[F.lit(v).alias(k) for k, v in parts.items()])).first()
    assert (round(r["debt"], 6), r["band"], round(r["confidence"], 6), r["retrieval_multiplier"]) == (26.65, "caution", 73.35, 1.2)
    p = spark.createDataFrame([(str(i), v, None, None, 0.0, None) for i, v in enumerate((0.9, 0.5, 0.4, 0.1, 0.0, 0.0))], "id string, drift double, churn double, lore_residual double, staleness double, ground_residual double")
    assert H.priority_pressure(p).first()[0] == pytest.approx(0.3609024390)
    n = spark.createDataFrame([("open", 0, DAY), ("open", 2, DAY + dt.timedelta(days=9)), ("close_failed", 1, DAY + dt.timedelta(days=9))], "status string, entry_count int, opened_at timestamp_ntz")
    got = H.hygiene(n, F.lit(DAY + dt.timedelta(days=10)).cast("timestamp_ntz")).first()
    assert (got["open"], got["empty"], got["dangling"], round(got["risk"], 6)) == (3, 1, 1, 0.6)


def test_scorecard(spark):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    rows = [(1, "r1", "ask", None, "show", True, at(0)), (2, "r1", "show", None, None, None, at(60)), (3, "r2", "ask", None, "recall", False, at(120)), (4, "r2", "recall", None, None, None, at(150)), (5, "r1", "trail", None, None, None, at(330)), (6, "r3", "ask", None, None, None, at(600)), (7, None, "open_narrative", "n1", None, None, at(700)), (8, None, "close_narrative", "n1", None, None, at(760)), (9, None, "open_narrative", "n2", None, None, at(820))]
    e = spark.createDataFrame(rows, "event_id int, result_id string, event_type string, subject string, primary_action string, stale_warning boolean, at timestamp_ntz")
    r = I.scorecard(e, spark.createDataFrame([(5.0,), (4.0,), (None,)], "score double")).first()
    assert (r["asks"], r["median_seconds"], r["clarity"], r["stale_follow_through"], r["trust"], r["loop_completion"]) == (3, 45.0, 1.0, 1.0, 4.5, 0.5)
    assert r["actionability"] == pytest.approx(2 / 3) and r["reuse"] == pytest.approx(2 / 3)
    empty = I.scorecard(e.limit(0), spark.createDataFrame([], "score double")).first()
    assert empty["asks"] == 0 and empty["reuse"] is None and empty["trust"] is None


def test_commits(spark):
    c = spark.createDataFrame([(i, 1, DAY + dt.timedelta(days=i)) for i in (1, 2, 3)], "id int, line int, committed_at timestamp_ntz")
    assert [r["id"] for r in VS.walk(c, "line", "committed_at", "id").orderBy("step").collect()] == [3, 2, 1]
    find = lambda ref: [r["id"] for r in VS.resolve_ref(c, ref, F.lit(DAY + dt.timedelta(days=4)).cast("timestamp_ntz")).collect()]
    assert [find(r) for r in ("main", "main~1", "main~2", "main@2024-01-03", "2d", "bogus", "2")] == [[3], [2], [1], [2], [2], [], [2]]
    tree = lambda rows: spark.createDataFrame(rows, "line int, concept_id string, chunk_id string")
    d = VS.tree_diff(tree([(1, "a", "a1"), (1, "b", "b1")]), tree([(1, "a", "a2"), (1, "c", "c1")])).collect()
    assert {(r["concept_id"], r["change"]) for r in d} == {("a", "modified"), ("b", "removed"), ("c", "added")}
    assert one(spark, VS.renamed(F.lit("old"), F.lit("new"))) == "old -> new" and one(spark, VS.lifecycle_kind(F.lit("lifecycle: merge a"))) == "merge" and one(spark, VS.lifecycle_kind(F.lit("x"))) is None


def test_leases(spark):
    now = F.lit(DAY).cast("timestamp_ntz")
    rows = [("s", 1, "leased", 0, DAY + dt.timedelta(1), DAY), ("s", 2, "queued", 1, None, DAY), ("s", 3, "queued", 0, None, DAY), ("s", 4, "leased", 0, DAY, DAY), ("t", 5, "done", 0, None, DAY)]
    jobs = spark.createDataFrame(rows, "scope string, id int, status string, attempt int, lease_expires_at timestamp_ntz, updated_at timestamp_ntz")
    assert [(r["scope"], r["id"], r["attempt"]) for r in Q.claim(jobs, now, "w", ["scope"], 1).collect()] == [("s", 3, 1)]
    assert {r["id"] for r in Q.claimable(jobs, now, 0).collect()} == {3, 4}
    assert {(r["id"], r["status"]) for r in Q.settle(jobs, F.lit("failed"), 0).collect()} == {(1, "queued"), (2, "failed"), (3, "queued"), (4, "queued"), (5, "queued")}


def test_views(spark):
    v = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("b", 1, None)], "id string, seq int, x double")
    assert {(r["id"], r["seq"], r["previous_x"]) for r in V.with_previous(v, "id", "seq", ["x"]).collect()} == {("a", 2, 0.5), ("b", 1, None)}
    c = spark.createDataFrame([("1", None), ("2", "1"), ("3", None)], "id string, s string")
    assert {r["id"] for r in V.not_superseded(c, "id", "s").collect()} == {"2", "3"}
    assert {(r["id"], r["x"]) for r in V.upsert(v, v.withColumn("x", F.lit(9.0)).where("seq = 2"), ["id"], "seq").collect()} == {("a", 9.0), ("b", None)}


def test_coverage_and_suggestions(spark):
    b = spark.createDataFrame([("c1", "s1", "manual", "h0", 1.0), ("c1", "s2", "mention", "h2", 0.5)], "concept_id string, symbol_id string, binding_type string, bound_body_hash string, confidence double")
    s = spark.createDataFrame([(f"s{i}", "f1" if i < 4 else "f2", f"n{i}", "class", f"h{i}", "exported") for i in range(1, 6)], "id string, source_file_id string, name string, kind string, body_hash string, export_status string")
    f = spark.createDataFrame([("f1", "a/b/x.ts", "ts", 3), ("f2", "a/b/y.ts", "ts", 0)], "id string, file_path string, language string, symbol_count int")
    c = spark.createDataFrame([("c1", "one"), ("c2", "two")], "id string, name string")
    assert {(r["concept_id"], r["bound"], r["reachable"], round(r["capacity"], 6)) for r in C.concept_coverage(b, s, c).collect()} == {("c1", 2, 3, 0.333333), ("c2", 0, 0, 1.0)}
    assert {r["symbol_id"] for r in C.uncovered(b, s, f, True).collect()} == {"s3", "s4", "s5"}
    assert [(r["symbol_id"], r["concept"]) for r in C.drifted(b, s, f, c).collect()] == [("s1", "one")]
    assert C.coverage_stats(b, s, f).first().asDict() == {"total_exported": 5, "bound_exported": 2, "files_with_bindings": 1, "total_files": 2}
    assert [(r["directory"], r["n"], r["score"]) for r in SG.coverage_gaps(C.uncovered(b, s, f)).collect()] == [("a/b", 3, 800 + 30 + 4.5)]
    v = spark.createDataFrame([(i, 1, [1.0, i / 10]) for i in range(8)] + [(9, 2, [1.0, 0.0]), (10, 1, [0.0, 0.0])], "id int, c int, v array<double>")
    got = {(r["a"], r["b"]) for r in SG.similar_pairs(v, "id", "c", "v", 0.9, block=3).collect()}
    cos = lambda i, j: (1 + i * j / 100) / (((1 + i * i / 100) * (1 + j * j / 100)) ** 0.5)
    assert got == {(i, j) for i in range(8) for j in range(i + 1, 8) if cos(i, j) >= 0.9}


def test_mentions_are_told_apart_without_a_shuffle_of_their_rows(spark):
    """Ids with several names give one row a text; ids that share a name, and one without id, give one each; found by names alone, rows are not shuffled again."""
    names = spark.createDataFrame([("getRow", "s1"), ("setRow", "s1"), ("getRow", "s2"), ("getRow", "s2"), ("setRow", None), ("no", "s3"), (None, "s4")], "name string, name_id string")
    docs = spark.createDataFrame([(1, "getRow setRow getRow"), (1, "setRow no"), (2, "getRow."), (3, None), (None, "setRow")], "id long, text string")
    out = T.mentions(docs, "id", "text", names)
    assert sorted(((r["id"] or 0, r["name_id"] or "") for r in out.collect())) == [(0, ""), (0, "s1"), (1, ""), (1, "s1"), (1, "s2"), (2, "s1"), (2, "s2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # the join that multiplies rows comes last: nothing is made distinct behind it


def test_texts(spark):
    assert T.coalesce_spans([10, 17, 24, 40]) == [(10, 24, 3), (40, 46, 1)] and T.coalesce_spans([41]) == [(41, 47, 1)]
    chunks = T.chunk_markdown("# A\n" + "x" * 40 + "\n```\n# no\n```\n# B\n" + "y" * 40, 15, 0.0)
    assert [h for _, h, _ in chunks] == ["A", "A > B"] and "# no" in chunks[0][0]
    assert [(op, x) for op, _, _, x in T.line_diff("a\nb", "a\nc")] == [("same", "a"), ("remove", "b"), ("add", "c")]
    assert T.line_diff("x\n" * 600, "y") == [] and T.line_diff("a", "a") == [] and len(T.line_diff("x\n" * 600, "x\n" * 601, max_lines=None)) == 4
    far = T.hunks(T.edit_script([str(i) for i in range(40)], ["x", *[str(i) for i in range(1, 30)], "y", *[str(i) for i in range(31, 40)]]))
    assert [(h[0][1:3], len(h)) for h in far] == [((1, 0), 5), ((28, 28), 8)] or len(far) == 2
    big = spark.createDataFrame([(1, "a\n" * 501, "b"), (2, None, "b")], "id int, old string, new string")
    assert {(r["id"], r["op"]) for r in T.line_diffs(big, "id").collect()} == {(1, "too-large"), (2, "remove"), (2, "add")}
    docs = spark.createDataFrame([(1, "uses parseJSON here"), (2, None)], "id int, text string")
    names = spark.createDataFrame([("parseJSON", "s1"), ("us", "s2"), ("pars", "s3")], "name string, name_id string")
    assert [(r["id"], r["name_id"]) for r in T.mentions(docs, "id", "text", names).collect()] == [(1, "s1")]


def test_chunk_files(spark, tmp_path):
    fields = {"fl_id": "01X", "fl_type": "chunk", "fl_supersedes": None, "topics": ["a", "b: c"]}
    raw = SC.render_chunk(fields, "state content")
    assert SC.parse_chunk(raw) == (fields, "state content") and SC.parse_chunk("no front") == ({}, "no front")
    (tmp_path / "main").mkdir()
    (tmp_path / "main" / "x.md").write_text(raw)
    data = SC.pack_embedding("m", np.array([1.5, -2.0]))
    assert SC.unpack_embedding(data) == ("m", [1.5, -2.0]) and SC.unpack_embedding(data[:-1]) is None and SC.unpack_embedding(b"x") is None
    (tmp_path / "main" / "x.emb").write_bytes(data)
    (tmp_path / "node_modules").mkdir()
    for p in ("a.ts", "node_modules/b.ts", "c.bin"):
        (tmp_path / p).write_text("let x")
    r = SC.read_chunks(spark, str(tmp_path)).first()
    assert (r["fl_id"], r["fl_type"], r["content"]) == ("01X", "chunk", "state content")
    assert [(r["model"], r["embedding"]) for r in SC.read_embeddings(spark, str(tmp_path)).collect()] == [("m", [1.5, -2.0])]
    assert [r["path"].rsplit("/", 1)[1] for r in SC.discover(spark, str(tmp_path)).collect()] == ["a.ts"]
    SC.write_chunks(spark.createDataFrame([("01X", "chunk")], "fl_id string, fl_type string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_code():
    ts = "export class A {\n  run() { go(1); }\n}\nfunction b() {\n  A.run();\n}\nmain();\nimport x from './u';\n"
    assert [(s["name"], s["kind"], s["export_status"]) for s in CODE.symbols_of(ts, "typescript")] == [("A", "class", "exported"), ("b", "function", "local")]
    assert ("b", "A.run", 5, "A.run();") in CODE.calls_of(ts, "typescript") and ("<module>", "main", 7, "main();") in CODE.calls_of(ts, "typescript")
    assert CODE.imports_of(ts, "typescript") == ["./u"] and CODE.resolve_import("a/b/c.ts", "../u", "typescript") == "a/u"
    assert CODE.resolve_import("a/b/c.py", "..config", "python") == "a/config" and CODE.imports_of("from .x import y", "python") == [".x"]


def test_lease_stream(spark, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    rows = [("q", "enqueue", 1, None, at(0)), ("q", "enqueue", 2, None, at(0)), ("q", "claim", None, "w1", at(1)), ("q", "failed", 1, "w1", at(2)), ("q", "claim", None, "w2", at(3)), ("q", "done", 2, "w2", at(4)), ("q", "claim", None, "w3", at(5)), ("q", "claim", None, "w4", at(6)), ("q", "claim", None, "w5", at(99))]
    schema = "scope string, op string, id long, owner string, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ST.lease_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), retries=2)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["id"], r["status"], r["owner"], r["attempt"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(1, "leased", "w1", 1), (1, "queued", "w1", 1), (2, "leased", "w2", 1), (2, "done", "w2", 1), (1, "leased", "w3", 2), (1, "leased", "w5", 3)]


def test_edit_scripts_follow_a_longest_common_subsequence():
    rng = random.Random(12)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        script = T.edit_script(a, b)
        assert sum(op == "same" for op, *_ in script) == lcs(a, b)
        assert [x for op, _, _, x in script if op != "add"] == a and [x for op, _, _, x in script if op != "remove"] == b


def test_three_way_merges(spark):
    base = "a\nb\nc\nd"
    assert T.merge3(base, "a\nB\nc\nd", "a\nb\nc\nD") == ("a\nB\nc\nD", 0)
    assert T.merge3(base, base, "x\n" + base) == ("x\n" + base, 0) and T.merge3(base, "a\nc\nd", "a\nc\nd") == ("a\nc\nd", 0)
    text, faults = T.merge3(base, "a\nX\nc\nd", "a\nY\nc\nd")
    assert faults == 1 and text == "a\n<<<<<<<\nX\n=======\nY\n>>>>>>>\nc\nd"
    df = spark.createDataFrame([(1, None, "n", None)], "id int, base string, ours string, theirs string")
    assert [tuple(r) for r in T.merged(df, "id").collect()] == [(1, "n", 0)]
