"""Suggestions and bootstrap plans (SG1-SG4): one DataFrame a kind, put together and ordered."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import depth, directory, kind_weight

# Limits of the kinds.
MERGE, RELATE, REVIEW, PULL, ARCHIVE_STALE, LORE, GROUND = 0.92, 0.70, 0.65, 0.3, 0.7, 0.55, 0.35
LEAST_GAP, MOST_GAPS, PER_FILE = 2, 8, 8


def similar_pairs(vectors: DataFrame, key: str, cluster: str, vector: str, least: float = RELATE, block: int = 512) -> DataFrame:
    """Pairs of one cluster with a cosine of least or more, a < b: the candidates for merging and relating.

    A cluster is cut into blocks of about block rows, and each pair of blocks is one task's product, so a
    cluster that holds most rows is spread and only the similar pairs are ever written.
    """
    sizes = vectors.groupBy(cluster).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    rows = vectors.join(sizes, cluster).select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).alias("v"), "__n").withColumn("own", F.pmod(F.xxhash64("k"), F.col("__n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select("c", "k", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(ids: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(g["v"].tolist(), dtype=np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        s = x @ x.T
        own, k = g["own"].to_numpy(), g["k"].to_numpy()
        a, b = np.nonzero((s >= least) & (k[:, None] < k[None, :]) & ((own[:, None] != own[None, :]) | (ids[1] == ids[2])))
        return pd.DataFrame({"a": k[a], "b": k[b], "cluster": ids[0], "similarity": s[a, b]})

    kind, group = vectors.schema[key].dataType.simpleString(), vectors.schema[cluster].dataType.simpleString()
    return rows.groupBy("c", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, cluster {group}, similarity double")


def merge_or_relate(pairs: DataFrame) -> DataFrame:
    """SG1: above MERGE merge, from RELATE on relate."""
    s = F.col("similarity")
    return pairs.where(s >= RELATE).withColumn("kind", F.when(s > MERGE, "merge").otherwise("relate"))


def review(concepts: DataFrame) -> DataFrame:
    """SG1: residual above REVIEW."""
    return concepts.where(F.col("residual") > REVIEW).select("id", F.lit("review").alias("kind"), F.col("residual").alias("confidence"))


def cluster_drift(concepts: DataFrame) -> DataFrame:
    """SG1: far from its peers, near to its code."""
    return concepts.where((F.col("lore_residual") > LORE) & (F.col("ground_residual") < GROUND)).select("id", F.lit("cluster-drift").alias("kind"), F.col("lore_residual").alias("confidence"))


def archive(concepts: DataFrame, related: DataFrame) -> DataFrame:
    """SG1: stale and without relations (related: id)."""
    return concepts.where(F.col("staleness") > ARCHIVE_STALE).join(related, "id", "left_anti").select("id", F.lit("archive").alias("kind"), F.col("staleness").alias("confidence"))


def symbol_drift(scores: DataFrame) -> DataFrame:
    """SG1: concepts with drifted bindings (id, n_drifted)."""
    return scores.select("id", F.lit("symbol-drift").alias("kind"), F.least(F.lit(1.0), 0.5 + 0.15 * F.col("n_drifted")).alias("confidence"))


def knowledge_pull(concepts: DataFrame) -> DataFrame:
    """SG1: concepts with coverage: .5 of what is uncovered, .3 staleness, .2 ground residual."""
    score = 0.5 * (1 - F.col("coverage")) + 0.3 * F.coalesce("staleness", F.lit(0.0)) + 0.2 * F.coalesce("ground_residual", F.lit(0.0))
    return concepts.select("id", F.lit("knowledge-pull").alias("kind"), score.alias("confidence")).where(F.col("confidence") > PULL)


def _directory_score(n: Column, kinds: Column, boost: Column | None = None) -> Column:
    out = (10 - F.least(F.col("depth"), F.lit(9))) * 100 + 10 * n + kinds
    return out if boost is None else out + 200 * F.coalesce(boost, F.lit(0))


def coverage_gaps(uncovered: DataFrame, most: int = MOST_GAPS) -> DataFrame:
    """SG2: directories of uncovered symbols (file_path, kind) by score; single symbols are no gap."""
    g = uncovered.groupBy(directory("file_path").alias("directory")).agg(F.count("*").alias("n"), F.sum(kind_weight("kind")).alias("kinds"))
    g = g.where(F.col("n") >= LEAST_GAP).withColumn("depth", depth("directory"))
    return g.withColumn("score", _directory_score(F.col("n"), F.col("kinds"))).orderBy(F.desc("score"), "directory").limit(most).select("directory", "n", "score")


def bootstrap_plan(uncovered: DataFrame, dependents: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """SG3: phases of directories by score, the shallow first; of each file the weightiest symbols. dependents: directory, n_dependents."""
    w = Window.partitionBy("file_path").orderBy(F.desc("weight"), "name", "symbol_id")
    s = uncovered.withColumn("directory", directory("file_path")).withColumn("weight", kind_weight("kind")).withColumn("place", F.row_number().over(w))
    g = s.groupBy("directory").agg(F.count("*").alias("n"), F.sum("weight").alias("kinds"), F.count_if(F.col("place") <= per_file).alias("shown")).withColumn("depth", depth("directory"))
    g = g.join(dependents, "directory", "left").withColumn("score", _directory_score(F.col("n"), F.col("kinds"), F.col("n_dependents")))
    return g.withColumn("phase", F.row_number().over(Window.orderBy(F.desc("score"), "directory"))).select("phase", "directory", "n", "shown", "score")  # a row a directory


def dependency_boost(imports: DataFrame) -> DataFrame:
    """SG4: of each directory the number of other directories that import from it. imports: from_path, to_path."""
    e = imports.select(directory("from_path").alias("source"), directory("to_path").alias("directory")).where("source <> directory")
    return e.groupBy("directory").agg(F.countDistinct("source").alias("n_dependents"))


def put_together(kinds: list[DataFrame], order: list[str], most: int) -> DataFrame:
    """SL4: all suggestions (id, kind, confidence) in order of kind, then confidence, then id."""
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    return reduce(DataFrame.unionByName, kinds).withColumn("priority", rank).orderBy("priority", F.desc("confidence"), "id").limit(most)


def narratives_to_settle(narratives: DataFrame, now: Column, dangling_days: int = 3) -> DataFrame:
    """SG1: close-narrative of those that are closing, whose close failed, or that are open for too long with entries; abandon-narrative of those without.

    narratives: id, status, opened_at, entry_count.
    """
    late = F.timestamp_diff("SECOND", F.col("opened_at"), now) > dangling_days * 86400
    kind = F.when(F.col("status").isin("closing", "close_failed"), "close-narrative").when((F.col("status") == "open") & late, F.when(F.col("entry_count") > 0, "close-narrative").otherwise("abandon-narrative"))
    return narratives.select("id", kind.alias("kind"), F.lit(1.0).alias("confidence")).where("kind is not null")


def relations_to_clean(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """SG1: id (of the far end), from_id: relations that lead to a concept (id, status) that is not active any more."""
    gone = concepts.where("status is not null and status <> 'active'").select(F.col("id").alias("to_id"))
    return relations.join(gone, "to_id").select(F.col("to_id").alias("id"), "from_id", F.lit("clean-relation").alias("kind"), F.lit(1.0).alias("confidence"))


def of_kinds(suggestions: DataFrame, kinds: list[str] | None) -> DataFrame:
    """PF11: those of some kinds; all without any."""
    return suggestions.where(F.col("kind").isin(kinds)) if kinds else suggestions


def with_impact(suggestions: DataFrame, pressures: DataFrame, fractions: dict[str, float], fiedler: float, raw_debt: float, debt: float) -> DataFrame:
    """SG1: what a suggestion would take off the debt: its concept's pressure (id, pressure) times its kind's fraction over 1 + fiedler, scaled from raw to shown debt."""
    share = F.coalesce(F.create_map(*[F.lit(x) for kv in fractions.items() for x in kv])[F.col("kind")], F.lit(0.0))
    raw = F.coalesce("pressure", F.lit(0.0)) * share / (1 + fiedler)
    points = raw / raw_debt * debt if raw_debt > 0 else raw
    return suggestions.join(pressures.select("id", "pressure"), "id", "left").drop("__p").withColumn("raw_reduction", raw).withColumn("reduction", points).drop("pressure")


def debt_reducers(suggestions: DataFrame, debt: float, most: int = 3) -> DataFrame:
    """SL4: the suggestions that take off the most, then by priority, confidence and id, each with the debt that is left behind it."""
    order = [F.desc(F.round("reduction", 9)), F.col("priority"), F.desc("confidence"), F.col("id"), F.col("kind")]
    top = suggestions.where(F.round("reduction", 9) > 0).orderBy(*order).limit(most)
    w = Window.orderBy(*order)  # most rows
    left = F.greatest(F.lit(0.0), F.lit(debt) - F.sum("reduction").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return top.withColumn("pos", F.row_number().over(w)).withColumn("debt_left", left)
