"""Keyword and vector lanes, their fusion, and the adjustments of a ranking (RT1-RT6, RT9-RT14, RT17, ST1, WN3-WN6).

Every limit has the id as its last key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import cosine_distance
from knotwork.operators.keywords import build_index

# The parameters of the fusions.
RRF_K, BM25_HALF = 60, 30


def bm25(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """RT1 over texts that have no index yet: it is made and asked once. Ask a kept index for more."""
    return build_index(texts.sparkSession, texts, key, text).search(terms)


def top(df: DataFrame, by: Column, key: str, k: int) -> DataFrame:
    """SL1: the first k by a column, then by key; a bounded heap in every task."""
    return df.orderBy(by, F.col(key)).limit(k)


def ranked(df: DataFrame, by: Column, key: str, k: int) -> DataFrame:
    """The first k with pos, from 0 (WN3)."""
    return top(df, by, key, k).withColumn("pos", F.row_number().over(Window.orderBy(by, F.col(key))) - 1)


def vector_distances(vectors: DataFrame, key: str, vector: str, query: list[float] | DataFrame) -> DataFrame:
    """RT2: the cosine distance of every vector to the query, exactly; the query is a literal or one row with q, so nothing is shuffled."""
    if isinstance(query, DataFrame):
        near = vectors.join(F.broadcast(query)).withColumn("distance", cosine_distance(vector, "q"))  # one row
        return near.select(key, *[c for c in vectors.columns if c not in (key, vector)], "distance")
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", cosine_distance(vector, q)).select(key, *[c for c in vectors.columns if c not in (key, vector)], "distance")


def rrf(lanes: dict[str, tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """RT5: the sum over lanes (key, pos from 0) of weight / (k + pos)."""
    parts = [d.select(key, (F.lit(w) / (k + F.col("pos"))).alias("s")) for d, w in lanes.values()]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("s").alias("score"))


def keyword_distance(pos: Column) -> Column:
    """RT7: the distance that a place in a keyword lane stands for."""
    return pos / (pos + BM25_HALF)


def merge_by_distance(lanes: list[DataFrame], key: str) -> DataFrame:
    """RT6, ST1: the least distance of each key over the lanes (key, distance); score is what is missing to 1."""
    return reduce(DataFrame.unionByName, [d.select(key, "distance") for d in lanes]).groupBy(key).agg(F.min("distance").alias("distance")).withColumn("score", 1 - F.col("distance"))


def structural_boost(results: DataFrame, matches: DataFrame, concept: str, boost: float = 0.05, floor: float = 1 / (RRF_K + 1)) -> DataFrame:
    """RT10: boost times the greatest confidence of a matched concept is added; matched concepts that are missing come in at floor first."""
    best = matches.groupBy(concept).agg(F.max("confidence").alias("confidence"))
    both = results.join(best, concept, "full_outer")
    return both.withColumn("injected", F.col("score").isNull()).withColumn("score", F.coalesce("score", F.lit(floor)) + boost * F.coalesce("confidence", F.lit(0.0)))


def staleness_penalty(score: Column, age_days: Column, threshold_days: float, multiplier: float = 1.0) -> Column:
    """RT11: a tenth at full age, times the band's multiplier, three tenths at most; never under .01."""
    stale = F.least(F.lit(1.0), age_days / threshold_days)
    return F.greatest(F.lit(0.01), score * (1 - F.least(F.lit(0.3), 0.1 * stale * multiplier)))


def best_per_concept(results: DataFrame, concept: str, key: str, by: str = "score", pos: str = "pos") -> DataFrame:
    """RT12, WN6: one row a concept, the best, in the place of the concept's first; rows without a concept all stay."""
    group = F.coalesce(F.concat(F.lit("c:"), F.col(concept).cast("string")), F.concat(F.lit("k:"), F.col(key).cast("string")))
    w = Window.partitionBy("__g").orderBy(F.col(by).desc(), pos)
    out = results.withColumn("__g", group).withColumn("slot", F.min(pos).over(Window.partitionBy("__g"))).withColumn("__rn", F.row_number().over(w))
    return out.where("__rn = 1").drop("__g", "__rn")


def journal_trail(entries: DataFrame, narrative: str, key: str, least: float = 0.005, per_narrative: int = 3, most: int = 30) -> DataFrame:
    """RT14, WN4: entries of at least a score, the best few of each narrative, then the best of all, with their narrative's best score."""
    w = Window.partitionBy(narrative).orderBy(F.desc("score"), key)
    kept = entries.where(F.col("score") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_narrative)
    return kept.orderBy(F.desc("score"), key).limit(most).withColumn("group_score", F.max("score").over(Window.partitionBy(narrative)))


def claim_confidence(claims: DataFrame, sources: DataFrame, claim: str, source: str) -> DataFrame:
    """RT17: .4 freshness + .4 relevance + .2 of the number of sources up to three; unknown sources count .5 in both."""
    j = claims.join(sources.select(source, "freshness", "relevance"), source, "left")
    half = F.lit(0.5)
    return j.groupBy(claim).agg((0.4 * F.avg(F.coalesce("freshness", half)) + 0.4 * F.avg(F.coalesce("relevance", half)) + 0.2 * F.least(F.lit(1.0), F.count("*") / 3)).alias("confidence"))


def ppr_fusion(results: DataFrame, signals: DataFrame, concept: str, alpha: float = 0.2, nodes: int = 40, inject: int = 5) -> DataFrame:
    """RT13: alpha times a concept's graph signal is added; the strongest concepts that are missing come in with it alone.

    signals: concept, ppr, confidence, seed of the symbols bound to a concept; of the nodes with the greatest ppr that
    are no seeds, the greatest is the unit. A concept's signal is its best one.
    """
    best = signals.where("not seed").orderBy(F.desc("ppr"), concept).limit(nodes)
    unit = best.agg(F.max("ppr").alias("unit"))
    s = best.join(F.broadcast(unit)).groupBy(concept).agg(F.max(F.col("ppr") / F.col("unit") * F.col("confidence")).alias("signal"))  # one row
    known = results.join(s, concept, "left").withColumn("score", F.col("score") + alpha * F.coalesce("signal", F.lit(0.0))).withColumn("injected", F.lit(False)).select(concept, "score", "injected")
    fresh = s.join(results.select(concept), concept, "left_anti").orderBy(F.desc("signal"), concept).limit(inject).select(concept, (alpha * F.col("signal")).alias("score"), F.lit(True).alias("injected"))
    return known.unionByName(fresh)


def enriched(results: DataFrame, bindings: DataFrame, drift: DataFrame, concept: str, most: int = 5) -> DataFrame:
    """RT8, RT15: results with their files, their best bindings by confidence and the number of drifted ones."""
    w = Window.partitionBy(concept).orderBy(F.desc("confidence"), "symbol_id")
    b = bindings.withColumn("rn", F.row_number().over(w)).groupBy(concept).agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", "symbol")))).alias("best"))
    d = drift.groupBy(concept).agg(F.count("*").alias("n_drifted"))
    out = results.join(b, concept, "left").join(d, concept, "left")
    return out.withColumn("symbols", F.col("best.symbol")).drop("best").withColumn("n_drifted", F.coalesce("n_drifted", F.lit(0)))
