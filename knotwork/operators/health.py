"""Staleness, pressure, debt and the signals made of them (HS1-HS14, HS16-HS20). now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import clamp

# Weights and limits of the scores.
ASK_WEIGHTS = {"staleness": 0.27, "symbol_drift": 0.23, "code_freshness": 0.18, "doc_freshness": 0.08, "coverage_gap": 0.10, "embedding_mismatch": 0.04, "hygiene": 0.05, "priority_pressure": 0.05}
BANDS = (("healthy", 25.0, 1.0, 1.0), ("caution", 50.0, 1.2, 1.15), ("high", 75.0, 1.4, 1.25), ("critical", None, 1.6, 1.5))
DRIFT_RESIDUAL, HOT, TREND, CRITICAL = 0.85, 20, 0.5, 1.35


def staleness(at: Column, now: Column, threshold_days: float) -> Column:
    """HS1."""
    return F.least(F.lit(1.0), F.timestamp_diff("SECOND", at, now) / 86400.0 / threshold_days)


def base_pressure(ground: str = "ground_residual", churn: str = "churn", lore: str = "lore_residual") -> Column:
    """HS4."""
    return 0.6 * F.coalesce(F.col(ground), F.col(churn), F.lit(0.0)) + 0.4 * F.coalesce(F.col(lore), F.lit(0.0))


def pressure(drift: str = "drift", stale: str = "staleness") -> Column:
    """HS8."""
    d, s = F.coalesce(F.col(drift), F.lit(0.0)), F.coalesce(F.col(stale), F.lit(0.0))
    return F.greatest(base_pressure(), s, d, DRIFT_RESIDUAL * d)


def total_debt(concepts: DataFrame, fiedler: float, by: list[str] | None = None) -> DataFrame:
    """HS4, AG13: the sum of the base pressures over 1 + fiedler, in all or for each group."""
    return concepts.groupBy(*(by or [])).agg((F.sum(base_pressure()) / (1 + fiedler)).alias("debt"))


def debt_trend(current: Column, previous: Column) -> Column:
    """HS5: the band is open at both ends."""
    return F.when(current > previous + TREND, "degrading").when(current < previous - TREND, "improving").otherwise("stable")


def live_debt(concepts: DataFrame, fiedler: float, persisted: float) -> DataFrame:
    """HS8: one row; concepts with a drift column."""
    return concepts.agg((F.sum(pressure()) / (1 + fiedler)).alias("live_debt")).withColumn("persisted_debt", F.lit(persisted)).withColumn("debt", F.greatest("live_debt", "persisted_debt"))


def hot_staleness(concepts: DataFrame, hot: int = HOT) -> DataFrame:
    """HS10: the mean staleness of the concepts under the highest pressure, weighted by it; key: id."""
    top = concepts.withColumn("p", pressure()).orderBy(F.desc("p"), "id").limit(hot)
    w = F.greatest(F.lit(0.001), F.col("p"))
    return top.agg(clamp(F.sum(F.coalesce("staleness", F.lit(0.0)) * w) / F.sum(w)).alias("hot_staleness"))


def priority_pressure(concepts: DataFrame) -> DataFrame:
    """HS10: .65 of the mean of the top five, .2 of the share from .4 on, .15 of the skew between top and all."""
    p = concepts.select("id", pressure().alias("p")).where("not isnan(p)")
    top = p.orderBy(F.desc("p"), "id").limit(5).agg(F.avg("p").alias("top"))
    all_ = p.agg(F.avg("p").alias("mean"), F.avg((F.col("p") >= 0.4).cast("double")).alias("hot"))
    skew = F.when(F.col("mean") > 0, clamp((F.col("top") - F.col("mean")) / F.greatest(F.lit(0.1), 1 - F.col("mean")))).otherwise(clamp("top"))
    return top.join(F.broadcast(all_)).select(clamp(0.65 * F.col("top") + 0.2 * F.col("hot") + 0.15 * skew).alias("priority_pressure"))  # one row each


def hygiene(narratives: DataFrame, now: Column, dangling_days: int = 3) -> DataFrame:
    """HS11: narratives: status, entry_count, opened_at."""
    open_ = narratives.where(F.col("status").isin("open", "close_failed"))
    late = F.timestamp_diff("SECOND", F.col("opened_at"), now) > dangling_days * 86400
    out = open_.agg(F.count("*").alias("open"), F.count_if(F.col("entry_count") <= 0).alias("empty"), F.count_if(late).alias("dangling"))
    risk = (F.col("empty") + 2 * F.col("dangling")) / F.greatest(F.lit(4), F.col("open") + 2 * F.col("dangling"))
    return out.withColumn("risk", F.when(F.col("open") == 0, 0.0).otherwise(clamp(risk)))


def ask_debt(components: DataFrame) -> DataFrame:
    """HS9: debt, confidence, band and the band's two multipliers from the columns of ASK_WEIGHTS."""
    debt = clamp(sum((F.lit(100.0 * w) * F.col(c) for c, w in ASK_WEIGHTS.items()), F.lit(0.0)), 100.0)

    def of(i: int) -> Column:
        out = F.lit(BANDS[-1][i])
        for b in reversed(BANDS[:-1]):
            out = F.when(F.col("debt") <= b[1], F.lit(b[i])).otherwise(out)
        return out

    return components.withColumn("debt", debt).withColumn("confidence", clamp(100 - F.col("debt"), 100.0)).withColumn("band", of(0)).withColumn("retrieval_multiplier", of(2)).withColumn("staleness_multiplier", of(3))


def state_distance(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """HS6: files: symbol_count, bound_count. Covered symbols stand for the concepts' mean ground residual, the others for 1."""
    c = concepts.agg(F.count("*").alias("n"), F.avg(F.coalesce("ground_residual", F.lit(0.0))).alias("mean"))
    f = files.agg(F.sum("symbol_count").alias("total"), F.sum("bound_count").alias("bound"))
    share = F.col("bound") / F.col("total")
    dark = F.greatest(F.lit(0.0), 1 - share)
    value = F.when(F.col("n") == 0, 1.0).when(F.coalesce("total", F.lit(0)) == 0, 0.0).when(share + dark <= 0, 0.0).otherwise(F.least(F.lit(1.0), (F.col("mean") * share + dark) / (share + dark)))
    return c.join(F.broadcast(f)).select(value.alias("state_distance"))  # one row each


def health_signals(concepts: DataFrame, relations: DataFrame, debt: float, fiedler: float) -> DataFrame:
    """HS12: concepts: id, name, staleness, drift, critical (boolean) and the residuals; relations: from_id, to_id, weight, active."""
    t, r = clamp("staleness"), clamp("drift")
    base = concepts.select("*", t.alias("time_stale"), r.alias("ref_stale"), (0.6 * t + 0.4 * r).alias("base"))
    shock = base.agg(clamp(0.5 * F.avg((F.col("base") >= 0.65).cast("double")) + 0.25 * F.avg((F.col("ref_stale") > 0).cast("double")) + 0.25 * clamp(F.lit(debt))).alias("global_shock"))
    e = relations.where("active = 1").select("from_id", "to_id", clamp("weight").alias("w"))
    ends = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "w", F.lit(0.3).alias("part")).unionAll(e.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "w", F.lit(0.7).alias("part")))
    around = ends.join(base.select(F.col("id").alias("other"), F.col("base").alias("other_base")), "other", "left").groupBy("id").agg(F.sum(F.when(F.col("other_base").isNotNull(), F.col("w"))).alias("known"), F.sum(F.col("w") * F.col("other_base")).alias("signal"), F.sum(F.col("w") * F.col("part")).alias("influence_raw"))
    j = base.join(around, "id", "left").join(F.broadcast(shock))  # one row
    local = F.when(F.col("known") > 0, clamp(F.col("signal") / F.col("known"))).otherwise(0.0)
    j = j.withColumn("local_graph_stale", local).withColumn("influence", clamp(F.coalesce("influence_raw", F.lit(0.0)) / 3)).withColumn("multiplier", F.when(F.col("critical"), CRITICAL).otherwise(1.0))
    final = (0.35 * F.col("time_stale") + 0.3 * F.col("ref_stale") + 0.2 * F.col("local_graph_stale") + 0.1 * F.col("global_shock") + 0.05 * F.col("influence")) * F.col("multiplier")
    j = j.withColumn("final_stale", clamp(final)).withColumn("pb", base_pressure())
    j = j.withColumn("residual_after", clamp(F.greatest("pb", F.col("final_stale") * F.col("multiplier") * 0.75)))
    after = j.agg((F.sum(0.6 * clamp(F.greatest("pb", F.col("final_stale") * 0.9))) / (1 + fiedler)).alias("debt_after"))
    return j.join(F.broadcast(after)).select("id", "name", "time_stale", "ref_stale", "local_graph_stale", "global_shock", "influence", "multiplier", "final_stale", "residual_after", "debt_after")  # one row


def heal(stale: Column, residual: Column, final: Column) -> tuple[Column, Column]:
    """HS14: staleness and residual after a repair under pressure final."""
    return F.greatest(F.lit(0.0), stale - (0.2 + 0.3 * final)), F.greatest(F.lit(0.0), residual - (0.12 + 0.25 * final))


def phase(distance: Column) -> Column:
    """HS17: how far a narrative has moved a concept."""
    return F.when(distance > 0.75, "structural").when(distance > 0.6, "strong").when(distance >= 0.45, "transition").otherwise("none")


def churn(chunks: DataFrame, key: str, supersedes: str, vector: str, distance: object) -> DataFrame:
    """HS2: each chunk's distance to the one it supersedes, 0 if there is none."""
    p = chunks.select(F.col(key).alias("__p"), F.col(vector).alias("__v"))
    return chunks.join(p, F.col(supersedes) == F.col("__p"), "left").withColumn("churn", F.when(F.col("__v").isNull(), 0.0).otherwise(distance(vector, "__v"))).drop("__p", "__v")


def maintenance_rate(narratives: DataFrame, now: Column, concepts: int, days: int = 14) -> DataFrame:
    """HS19: closed narratives a week over the last days, against the rate wanted for that many concepts."""
    recent = F.timestamp_diff("SECOND", F.col("closed_at"), now).between(0, days * 86400)
    out = narratives.agg(F.count_if(recent & (F.col("status") == "closed")).alias("closed"))
    return out.select("closed", (F.col("closed") / (days / 7)).alias("per_week"), F.greatest(F.lit(1), F.ceil(F.lit(concepts) / 10)).cast("int").alias("wanted"))


def version_delta(history: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """WN2, HS22: each row with what changed since the one before it."""
    w = Window.partitionBy(key).orderBy(order)
    return history.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in columns])
