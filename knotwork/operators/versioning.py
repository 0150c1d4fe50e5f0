"""Commits, trees and their differences (LC1-LC6, LC12, JN13, JN14, SF17, SF18)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.history import diff

# The forms of a reference and of a lifecycle message.
REF_FORMS = {"ulid": r"^[0-9A-HJKMNP-TV-Z]{26}$", "ago": r"^(\d+)([wdhm])$", "back": r"^main~(\d+)$", "day": r"^main@(\d{4}-\d{2}-\d{2})$"}
LIFECYCLE = r"^lifecycle: (archive|restore|rename|merge|split|patch)\b"


def apply_patch(current: DataFrame, patch: DataFrame, key: str, keep: list[str], seq: Column) -> DataFrame:
    """LC1: the next version of each patched row: a patch column <c> replaces the value where set_<c> is true, null included."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in keep], *[f"set_{c}" for c in keep])
    return current.join(p, key).select(key, *[F.when(F.col(f"set_{c}"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in keep], seq.alias("seq"))


def with_parent(commits: DataFrame, line: str, at: str, key: str) -> DataFrame:
    """LC2: each commit with the one before it on its line."""
    w = Window.partitionBy(line).orderBy(at, key)
    return commits.withColumn("parent_id", F.lag(key).over(w)).withColumn("position", F.row_number().over(w))


def walk(commits: DataFrame, line: str, at: str, key: str, most: int = 50) -> DataFrame:
    """LC3: of each line the newest commits, step 0 the head. A line is a chain, so its order is its ancestry."""
    w = Window.partitionBy(line).orderBy(F.desc(at), F.desc(key))
    return commits.withColumn("step", F.row_number().over(w) - 1).where(F.col("step") < most)


def tree_diff(before: DataFrame, after: DataFrame, line: str = "line") -> DataFrame:
    """LC4, JN14: line, concept_id, change, old and new chunk_id of two trees (line, concept_id, chunk_id) a line."""
    d = diff(before, after, [line, "concept_id"], ["chunk_id"]).where("change <> 'same'")
    return d.withColumn("change", F.when(F.col("change") == "inserted", "added").when(F.col("change") == "deleted", "removed").otherwise("modified"))


def renamed(old: Column, new: Column) -> Column:
    """LC4: both names if they differ."""
    return F.when(old.isNotNull() & new.isNotNull() & (old != new), F.concat(old, F.lit(" -> "), new)).otherwise(F.coalesce(new, old))


def version_chain(versions: DataFrame, key: str, order: str) -> DataFrame:
    """LC6, WN7: number of each version in its key, and its neighbours."""
    w = Window.partitionBy(key).orderBy(order)
    return versions.withColumn("version", F.row_number().over(w)).withColumn("previous_version_id", F.lag("version_id").over(w)).withColumn("next_version_id", F.lead("version_id").over(w))


def lifecycle_kind(message: Column) -> Column:
    """SF18: null if the message is none."""
    return F.nullif(F.regexp_extract(message, LIFECYCLE, 1), F.lit(""))


def resolve_ref(commits: DataFrame, ref: str, now: Column) -> DataFrame:
    """LC5, SF17: the commit (id, committed_at) that a reference names: at most one row.

    main is the newest by (time, id); main~n the n-th before it; main@day and n weeks, days, hours or minutes
    ago the newest not after that moment; an id itself. Anything else names nothing.
    """
    newest = [F.desc("committed_at"), F.desc("id")]
    if ref == "main":
        return commits.orderBy(*newest).limit(1)
    if m := re.match(REF_FORMS["back"], ref):
        n = int(m[1])
        return commits.orderBy(*newest).limit(n + 1).orderBy("committed_at", "id").limit(1) if n else commits.orderBy(*newest).limit(1)
    if m := re.match(REF_FORMS["day"], ref):
        return commits.where(F.col("committed_at") < F.date_add(F.lit(m[1]).cast("date"), 1)).orderBy(*newest).limit(1)
    if m := re.match(REF_FORMS["ago"], ref):
        unit = {"w": "WEEK", "d": "DAY", "h": "HOUR", "m": "MINUTE"}[m[2]]
        return commits.where(F.col("committed_at") <= now - F.expr(f"INTERVAL {m[1]} {unit}")).orderBy(*newest).limit(1)
    return commits.where(F.col("id").cast("string") == ref).limit(1)


def fold_lifecycle(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """LC12: the status of each key after its last archive, restore or merge; other kinds leave it."""
    status = F.when(F.col(kind) == "archive", "archived").when(F.col(kind) == "merge", "merged").when(F.col(kind) == "restore", "active")
    return events.where(status.isNotNull()).groupBy(key).agg(F.max_by(status, order).alias("status"))
