"""Lease queues over an append-only job table (QU2-QU6, PF9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Time to live of a lease in seconds, and its least.
LEASE_SECONDS, LEAST_SECONDS = 30, 1


def attempts_allowed(retries: int | None) -> int:
    return max(retries or 0, 0) + 1


def claimable(jobs: DataFrame, now: Column, retries: int | None = 0) -> DataFrame:
    """QU2: jobs (id, status, attempt, lease_expires_at, updated_at) that may be claimed, with their place in the queue's order."""
    open_ = (F.col("status") == "queued") | ((F.col("status") == "leased") & (F.col("lease_expires_at") <= now))
    return jobs.where(open_ & (F.col("attempt") < attempts_allowed(retries))).withColumn("state_rank", F.when(F.col("status") == "queued", 0).otherwise(1))


def claim(jobs: DataFrame, now: Column, owner: str, scope: list[str], retries: int | None = 0, seconds: int = LEASE_SECONDS) -> DataFrame:
    """QU2: the next version of the first claimable job of each scope; one writer a scope appends it."""
    order = F.struct("state_rank", "attempt", "updated_at", "id")
    rest = [c for c in jobs.columns if c not in scope]
    first = claimable(jobs, now, retries).groupBy(*scope).agg(F.min_by(F.struct(*rest), order).alias("r"))
    out = first.select(*scope, "r.*")
    ttl = max(LEAST_SECONDS, seconds)
    return out.select(*scope, "id", F.lit("leased").alias("status"), F.lit(owner).alias("owner"), (F.col("attempt") + 1).alias("attempt"), (now + F.expr(f"INTERVAL {ttl} SECONDS")).alias("lease_expires_at"), now.alias("updated_at"))


def settle(jobs: DataFrame, outcome: Column, retries: int | None = 0) -> DataFrame:
    """QU3: the status after outcome ('done', 'skipped', 'failed'): a failed job is queued again while attempts are left."""
    new = F.when(outcome == "failed", F.when(F.col("attempt") < attempts_allowed(retries), "queued").otherwise("failed")).otherwise(outcome)
    return jobs.withColumn("status", new)


def counts(jobs: DataFrame, scope: list[str]) -> DataFrame:
    """QU4, AG2: jobs of each status and the oldest pending one."""
    pending = F.col("status").isin("queued", "leased")
    return jobs.groupBy(*scope).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "leased", "done", "failed")], F.min(F.when(pending, F.col("updated_at"))).alias("oldest_pending"))
