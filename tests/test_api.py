"""The facade, lifecycle, hooks and schemas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knotwork import models, schema
from knotwork.api import KnowledgeGraph
from knotwork.operators import graph as G
from knotwork.operators import lifecycle as L
from knotwork.operators import retrieval as R

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def kg(spark):
    names = schema.SCHEMAS["concepts"].names
    row = lambda **k: tuple(k.get(n) for n in names)
    concepts = [row(seq=1, version_id="v1", id="c1", name="Auth", active_chunk_id="k1", residual=0.2, staleness=0.1), row(seq=2, version_id="v2", id="c1", name="Auth", active_chunk_id="k2", residual=0.8, staleness=0.1), row(seq=3, version_id="v3", id="c2", name="Old", active_chunk_id="k3", lifecycle_status="archived"), row(seq=4, version_id="v4", id="c3", name="Lone", staleness=0.9)]
    chunk = schema.SCHEMAS["chunks"].names
    crow = lambda **k: tuple(k.get(n) for n in chunk)
    chunks = [crow(id="k1", fl_type="chunk", concept_id="c1", content="auth cache model"), crow(id="k2", fl_type="chunk", concept_id="c1", supersedes_id="k1", content="auth cache model again"), crow(id="k3", fl_type="chunk", concept_id="c2", content="auth of old"), crow(id="k4", fl_type="doc", concept_id=None, content=None)]
    commits = [("m1", None, None, None, "", DAY), ("m2", None, "m1", None, "", DAY + dt.timedelta(1))]
    tree = [("m1", "c1", "k1", None), ("m2", "c1", "k2", None), ("m2", "c2", "k3", None)]
    make = lambda rows, name: spark.createDataFrame(rows, schema.SCHEMAS[name])
    return KnowledgeGraph(spark, {"concepts": make(concepts, "concepts"), "chunks": make(chunks, "chunks"), "commits": make(commits, "commits"), "commit_tree": make(tree, "commit_tree")})


def test_reading_calls(kg):
    assert [r["name"] for r in kg.ls().collect()] == ["Auth", "Lone"]
    assert kg.show("auth").first()["content"] == "auth cache model again"
    assert [r["version"] for r in kg.history("AUTH").orderBy("version").collect()] == [1, 2]
    assert [r["id"] for r in kg.ask("authCache?").collect()] == ["k2"] and kg.ask("nothing").count() == 0
    now = F.lit(DAY).cast("timestamp_ntz")
    assert {(r["concept_id"], r["change"]) for r in kg.diff("main~1", "main", now).collect()} == {("c1", "modified"), ("c2", "added")}
    assert [r["id"] for r in kg.log().collect()] == ["m2", "m1"]


def test_analytic_calls(kg, spark):
    assert {(r["id"], r["kind"]) for r in kg.suggestions().collect()} == {("c1", "review"), ("c3", "archive")}
    assert kg.coverage().first()["total_exported"] == 0 and kg.bootstrap().count() == 0 and kg.jobs().count() == 0
    assert kg.status().first()["debt"] > 0 and kg.health(["c1"]).count() == 2
    assert kg.symbol_search("x").count() == 0 and kg.relations().count() == 0
    req = spark.createDataFrame([("q", ["auth", "Old", "New", "auth"])], "request_id string, targets array<string>")
    assert {(r["target"], r["verdict"]) for r in kg.open(req).collect()} == {("auth", "ok"), ("Old", "inactive"), ("New", "missing")}
    new = kg.rename("c1", "Auth2", "v9", F.lit(DAY).cast("timestamp_ntz"), F.lit(99)).first()
    assert (new["name"], new["version_id"], new["seq"]) == ("Auth2", "v9", 99)


def test_routing_and_closing(spark):
    n = spark.createDataFrame([("one", ["a"]), ("two", ["a", "b"]), ("free", None)], "narrative string, targets array<string>")
    e = spark.createDataFrame([(1, "one", None), (2, "two", None), (3, "two", ["b"]), (4, "one", ["z"]), (5, "free", ["z", "z"]), (6, "free", None)], "entry_id int, narrative string, requested array<string>")
    assert {r["entry_id"]: (r["verdict"], r["concepts"]) for r in L.route_entry(e, n).collect()} == {1: ("inherited", ["a"]), 2: ("ambiguous", []), 3: ("ok", ["b"]), 4: ("outside", ["z"]), 5: ("ok", ["z"]), 6: ("free", [])}
    tree = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "concept_id string, chunk_id string")
    written = spark.createDataFrame([("a", "9"), ("c", None), ("d", "4")], "concept_id string, chunk_id string")
    assert {tuple(r) for r in L.next_tree(tree, written).collect()} == {("a", "9"), ("b", "2"), ("d", "4")}


def test_hooks(spark):
    emb = models.HashingEmbedder(8)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in models.embed(df, "id", "text", emb, 1).collect()}
    assert got[1] == pytest.approx(emb.embed_batch(["a b"])[0], abs=1e-6) and set(got[2]) == {0.0}
    gen = models.PlainGenerator()
    assert gen.segment("a\n\nb") == ["a", "b"] and gen.merge("x", "x", "y") == "y" and gen.merge("x", "z", "x") == "z"
    models.register_sql_functions(spark)
    assert spark.sql("SELECT vec_distance_cosine(array(1D, 0D), array(-1D, 0D)) AS a, vec_distance_cosine(array(0D), array(1D)) AS b").first().asDict() == {"a": 2.0, "b": 1.0}
    r = spark.createDataFrame([("a", 0.5, 0), ("b", 0.4, 1)], "id string, score double, pos int")
    assert {(x["id"], x["score"]) for x in models.rerank(r, spark.createDataFrame([("b", 0.9)], "id string, new double"), "id", 2).collect()} == {("a", 0.0), ("b", 0.9)}


def test_schema_audit(spark):
    df = spark.createDataFrame([("1", 2)], "id string, embedding int").withColumn("more", F.lit(1))
    assert ("more", "extra", "", "int") in schema.audit(df, "embeddings") and ("embedding", "type", "array<float>", "int") in schema.audit(df, "embeddings")
    assert schema.audit(schema.repaired(df.drop("embedding"), "embeddings"), "embeddings") == []


def test_graph_fusion_and_lore(spark):
    res = spark.createDataFrame([("a", 0.5)], "concept string, score double")
    sig = spark.createDataFrame([("a", 0.2, 1.0, False), ("b", 0.4, 0.5, False), ("s", 0.9, 1.0, True)], "concept string, ppr double, confidence double, seed boolean")
    assert {(r["concept"], round(r["score"], 6), r["injected"]) for r in R.ppr_fusion(res, sig, "concept").collect()} == {("a", 0.6, False), ("b", 0.1, True)}
    sim = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.1)], "a int, b int, weight double")
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node int, cluster int")
    assert {(r["node"], round(r["lore_residual"], 6)) for r in G.lore_residuals(sim, lab).collect()} == {(1, 0.2), (2, 0.2), (3, 0.0)}
    assert G.disconnected_clusters(sim, lab).count() == 0 and G.disconnected_clusters(sim.limit(1), lab).count() == 1
