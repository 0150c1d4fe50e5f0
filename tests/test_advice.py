"""Cases that the review of round 1 named."""

import datetime

import numpy as np
import pytest

from knotwork.operators import graph as G
from knotwork.plans import analytics
from knotwork.scratch import Scratch


def test_pairs_of_every_model(spark, tmp_path):
    """Chunks of a second model are compared; vectors of different models are not; a pair comes once."""
    t = datetime.datetime(2024, 1, 1)
    one, two, other = [1.0] + [0.0] * 63, [0.9, 0.1] + [0.0] * 62, [0.0, 1.0] + [0.0] * 62
    wide, near = [1.0] + [0.0] * 95, [1.0, 0.4] + [0.0] * 94
    rows = [("C1", one, "lorevec-text-64"), ("C2", two, "lorevec-text-64"), ("C3", wide, " Lorevec-Text-V0"), ("C4", near, "lorevec-text-v0"), ("C4", other, "lorevec-text-64"), ("C5", wide, "lorevec-text-64"), ("C6", wide, "lorevec-text-v0")]
    # C7 and C8: .5 under text-64, 1 under code-64
    rows += [("C7", one, "lorevec-text-64"), ("C8", [0.5, 0.0, 0.75**0.5] + [0.0] * 61, "lorevec-text-64"), ("C7", other, "lorevec-code-64"), ("C8", other, "lorevec-code-64")]
    cluster = {"C6": 2, "C7": 3, "C8": 3}
    spark.createDataFrame([(f"C{i}", cluster.get(f"C{i}", 1), t) for i in range(1, 9)], "fl_id string, fl_cluster int, fl_created_at timestamp_ntz").write.parquet(f"{tmp_path}/state_chunks.parquet")
    spark.createDataFrame([("lorevec-text-64", 64), ("lorevec-code-64", 64), ("lorevec-text-v0", 96)], "model string, dim int").write.parquet(f"{tmp_path}/embed_models.parquet")
    spark.createDataFrame([(f"E{i}", c, v, m, t) for i, (c, v, m) in enumerate(rows)], "id string, chunk_id string, embedding array<float>, model string, embedded_at timestamp_ntz").write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    got = sorted((r["a"], r["b"], r["cluster"], r["similarity"], r["kind"]) for r in analytics.suggest_merge_relate(spark, str(tmp_path)).collect())
    assert got == [("C1", "C2", 1, 0.993884, "merge"), ("C3", "C4", 1, 0.928477, "merge"), ("C7", "C8", 3, 1.0, "merge")]


def test_chains_in_nine_thousand_rows_stay_whole(spark):
    """Chains of five in which only neighbours are alike: each link that is not compared splits a cluster."""
    clusters = pytest.importorskip("knotwork.llm.clusters")
    rng = np.random.default_rng(5)
    chains, t = 1800, datetime.datetime(2024, 1, 1)
    base = np.linalg.qr(rng.standard_normal((chains, 64, 6)))[0]
    rows = []
    for j in range(5):  # a step of 34 degrees, each in a direction of its own
        x = base[:, :, 0] if j == 0 else np.cos(0.6) * x + np.sin(0.6) * base[:, :, j]
        rows += [(f"E{c:04d}{j}", f"C{c:04d}{j}", x[c].tolist(), "m", t) for c in range(chains)]
    e = spark.createDataFrame(rows, "id string, chunk_id string, embedding array<float>, model string, embedded_at timestamp")
    models = spark.createDataFrame([("m", 64)], "model string, dim int")
    got = clusters.similarity_clusters(spark, e, models, e.selectExpr("chunk_id chunk", "model"))[0].select("chunk", "cluster_id").collect()
    assert {r["chunk"]: r["cluster_id"] for r in got} == {f"C{c:04d}{j}": f"C{c:04d}0" for c in range(chains) for j in range(5)}


def test_gaps_of_more_than_two_thousand_clusters(spark):
    labels = spark.range(2100).selectExpr("id node", "id cluster")
    edges = spark.createDataFrame([(0, 2099), (7, 3)], "a long, b long")
    assert G.disconnected_clusters(edges, labels).count() == 2100 * 2099 // 2 - 2


@pytest.mark.parametrize("case", ["no ids", "one id", "one row"])
def test_the_fitting_sample_is_bounded_whatever_the_ids(spark, monkeypatch, case):
    vectors, forest = pytest.importorskip("knotwork.llm.vectors"), pytest.importorskip("knotwork.llm.forest")
    seen = []
    one = "cast(null as string)" if case == "no ids" else "'E1'"
    angle = "1" if case == "one row" else "id"
    e = spark.range(20_000).selectExpr(f"{one} id", f"concat('C', {angle}) chunk_id", "timestamp_ntz'2024-01-01 00:00:00' embedded_at", f"array(float(sin({angle})), float(cos({angle}))) embedding", "'m' model")
    monkeypatch.setattr(vectors, "fit_forest", lambda x, *rest: seen.append(len(x)) or forest.fit_forest(x, *rest))
    found = vectors.Vectors(Scratch(spark), vectors.usable(e, spark.createDataFrame([("m", 2)], "model string, dim int")))
    vectors.to_cells(spark, found.rows, found.counts, 0.8, sample=500)
    assert seen[0] <= 1 if case == "one row" else 350 <= seen[0] <= 650
