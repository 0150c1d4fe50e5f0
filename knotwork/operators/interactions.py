"""The scorecard over interaction events (HS21, JN18, JN19, AG11, WN9).

events: event_id, result_id, event_type, subject, primary_action, stale_warning, at. Follow-ups meet their
ask by an equi-join on result_id with a range of time; results with very many events are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds that follow up, kinds that reuse, and the two windows in seconds.
FOLLOW_UPS, REUSES, ACT, REUSE = ("recall", "show", "trail", "open_narrative"), ("recall", "trail"), 600, 1800


def follow_ups(events: DataFrame, within: int = ACT) -> DataFrame:
    """JN18, WN9: for each ask the first follow-up within so many seconds: ask_id, follow_id, follow_type, seconds."""
    a = events.where("event_type = 'ask'").select(F.col("event_id").alias("ask_id"), "result_id", F.col("at").alias("asked"), "primary_action", "stale_warning")
    f = events.where(F.col("event_type").isin(*FOLLOW_UPS)).select(F.col("event_id").alias("follow_id"), "result_id", F.col("event_type").alias("follow_type"), F.col("at").alias("followed"))
    j = a.join(f, "result_id").where((F.col("followed") >= F.col("asked")) & (F.col("followed") <= F.col("asked") + F.expr(f"INTERVAL {within} SECONDS")))
    first = j.groupBy("ask_id").agg(F.min(F.struct("followed", "follow_id", "follow_type", "asked", "primary_action", "stale_warning")).alias("m"))
    return first.select("ask_id", F.col("m.follow_id").alias("follow_id"), F.col("m.follow_type").alias("follow_type"), (F.timestamp_diff("MICROSECOND", F.col("m.asked"), F.col("m.followed")) / 1e6).alias("seconds"), F.col("m.primary_action").alias("primary_action"), F.col("m.stale_warning").alias("stale_warning"))


def reused(events: DataFrame, within: int = REUSE) -> DataFrame:
    """JN18: asks with a reuse within so many seconds."""
    return follow_ups(events.where(F.col("event_type").isin("ask", *REUSES)), within).select("ask_id")


def closed_loops(events: DataFrame) -> DataFrame:
    """JN19: opened narratives with a close of the same subject at the same time or later: only the last close matters."""
    o = events.where("event_type = 'open_narrative' and subject is not null").select("event_id", "subject", "at")
    c = events.where("event_type = 'close_narrative' and subject is not null").groupBy("subject").agg(F.max("at").alias("last_close"))
    return o.join(c, "subject").where("last_close >= at").select("event_id")


def scorecard(events: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of all measures; a rate without a denominator is null. scores: score (null and NaN don't count)."""
    asks = events.agg(F.count_if(F.col("event_type") == "ask").alias("asks"), F.count_if(F.col("event_type") == "open_narrative").alias("opened"), F.count_if(F.col("event_type") == "close_narrative").alias("closed"), F.count_if((F.col("event_type") == "ask") & F.coalesce("stale_warning", F.lit(False)) & F.col("result_id").isNotNull()).alias("stale_asks"))
    f = follow_ups(events)
    acted = f.agg(F.count("*").alias("acted"), F.median("seconds").alias("median_seconds"), F.count_if(F.col("follow_type") == F.col("primary_action")).alias("clear"), F.count_if(F.coalesce("stale_warning", F.lit(False))).alias("stale_hits"))
    again, loops = reused(events).agg(F.count("*").alias("reused")), closed_loops(events).agg(F.count("*").alias("loops"))
    trust = scores.where("score is not null and not isnan(score)").agg(F.avg("score").alias("trust"), F.count("*").alias("scored"))
    one = asks
    for x in (acted, again, loops, trust):
        one = one.join(F.broadcast(x))  # one row each
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return one.select("asks", "opened", "closed", "scored", rate("acted", "asks").alias("actionability"), "median_seconds", rate("reused", "asks").alias("reuse"), rate("clear", "acted").alias("clarity"), rate("stale_hits", "stale_asks").alias("stale_follow_through"), "trust", rate("loops", "opened").alias("loop_completion"))
