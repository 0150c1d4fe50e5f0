"""Interaction events as streams (QU1-QU7): deduplication, follow-ups, windows, and the lease queue as state.

Watermarks bound the state: events later than the watermark are dropped, as the batch operators do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from knotwork.operators.interactions import ACT, FOLLOW_UPS
from knotwork.operators.queues import LEASE_SECONDS, LEAST_SECONDS, attempts_allowed

_JOB = "scope string, id long, status string, owner string, attempt int"


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "at", delay: str = "30 minutes") -> DataFrame:
    """QU1: an event that is sent again within the watermark comes through once."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def follow_up_stream(events: DataFrame, delay: str = "40 minutes", within: int = ACT) -> DataFrame:
    """QU7, JN18: pairs of an ask and a follow-up of the same result within so many seconds; both sides' state ends with the watermark."""
    a = events.where("event_type = 'ask'").select(F.col("event_id").alias("ask_id"), "result_id", F.col("at").alias("asked")).withWatermark("asked", delay)
    f = events.where(F.col("event_type").isin(*FOLLOW_UPS)).select(F.col("event_id").alias("follow_id"), F.col("result_id").alias("r"), F.col("at").alias("followed")).withWatermark("followed", delay)
    return a.join(f, F.expr(f"result_id = r AND followed >= asked AND followed <= asked + INTERVAL {within} SECONDS")).select("ask_id", "follow_id", "asked", "followed")


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "30 minutes") -> DataFrame:
    """QU7 (extension): events of each kind in windows."""
    return events.withWatermark("at", delay).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """QU7 (extension): runs of events of one result without a longer gap."""
    return events.withWatermark("at", delay).groupBy(F.session_window("at", gap), "result_id").agg(F.count("*").alias("n"))


def lease_stream(commands: DataFrame, retries: int = 0, seconds: int = LEASE_SECONDS) -> DataFrame:
    """QU2, QU3: the answers of a lease queue to commands (scope, op, id, owner, at), one state a scope.

    op: enqueue, claim (of the first job that is queued or whose lease ran out), done or failed. A scope's state
    holds its open jobs only. Commands of a batch are taken in order of at, then id.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs: dict[int, list] = {int(j[0]): list(j[1:]) for j in (state.get[0] if state.exists else [])}
        out, limit, ttl = [], attempts_allowed(retries), max(LEAST_SECONDS, seconds)
        rows = pd.concat(list(batches)).sort_values(["at", "id"], na_position="last")
        for r in rows.itertuples(index=False):
            t = r.at.timestamp()
            if r.op == "enqueue":
                jobs.setdefault(int(r.id), ["queued", "", 0, 0.0, t])
            elif r.op == "claim":
                ready = [(j[0] != "queued", j[2], j[4], i) for i, j in jobs.items() if j[2] < limit and (j[0] == "queued" or j[3] <= t)]
                if ready:
                    i = min(ready)[3]
                    jobs[i] = ["leased", r.owner, jobs[i][2] + 1, t + ttl, t]
                    out.append((key[0], i, "leased", r.owner, jobs[i][2]))
            elif int(r.id) in jobs and jobs[int(r.id)][1] == r.owner:
                i = int(r.id)
                j = jobs.pop(i)
                if r.op == "failed" and j[2] < limit:
                    jobs[i] = ["queued", "", j[2], 0.0, t]
                out.append((key[0], i, "queued" if i in jobs else r.op, r.owner, j[2]))
        state.update(([[i, *j] for i, j in jobs.items()],))
        yield pd.DataFrame(out, columns=["scope", "id", "status", "owner", "attempt"])

    kept = "jobs array<struct<id: long, status: string, owner: string, attempt: int, expires: double, updated: double>>"
    return commands.groupBy("scope").applyInPandasWithState(run, _JOB, kept, "append", GroupStateTimeout.NoTimeout)
