"""Views over append-only and keyed tables: latest and earlier versions, lifecycle guards, set-like filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """WN1: of each key the row of the greatest order. Spark keeps one row a key before it shuffles."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def with_previous(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """WN2: the latest row of each key and, as previous_<column>, what the one before it had."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    rows = df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2").select("*", *[F.lead(c).over(w).alias(f"previous_{c}") for c in columns])
    return rows.where("__rn = 1").drop("__rn")


def is_active(status: Column | str) -> Column:
    """PF1: null counts as active."""
    c = F.col(status) if isinstance(status, str) else status
    return c.isNull() | (c == "active")


def not_superseded(chunks: DataFrame, key: str, supersedes: str) -> DataFrame:
    """JN3: rows that no row supersedes; null supersedes nothing."""
    gone = chunks.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("__gone")).distinct()
    return chunks.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SK4, SK5: union of both, of each key the row of the greatest order; incoming wins a tie."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def hash_diff(stored: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """SC11 (without re-attaching bindings), SC13: key and what an incremental scan does with it: add, change, remove or skip."""
    s = stored.select(F.col(key).alias("sk"), F.col(digest).alias("sd"))
    f = found.select(F.col(key).alias("fk"), F.col(digest).alias("fd"))
    action = F.when(F.col("sk").isNull(), "add").when(F.col("fk").isNull(), "remove").when(F.col("sd").eqNullSafe(F.col("fd")), "skip").otherwise("change")
    return s.join(f, F.col("sk") == F.col("fk"), "full_outer").select(F.coalesce("sk", "fk").alias(key), action.alias("action"))


def positions(df: DataFrame, key: str, at: str, tie: str, out: str = "position") -> DataFrame:
    """WN5: the place of each row in its key by time, then by tie, from 1. Places are counted within a day and days are added up, so no key is sorted by one task."""
    day = df.withColumn("__d", F.coalesce(F.to_date(at), F.lit("0001-01-01").cast("date")))
    near = day.withColumn("__i", F.row_number().over(Window.partitionBy(key, "__d").orderBy(at, tie)))
    w = Window.partitionBy(key).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    days = day.groupBy(key, "__d").agg(F.count("*").alias("__n")).select(F.col(key).alias("__k"), F.col("__d").alias("__e"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    j = near.join(days, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__d") == F.col("__e")))
    return j.withColumn(out, (F.col("__i") + F.col("__before")).cast("int")).drop("__d", "__i", "__k", "__e", "__before")
