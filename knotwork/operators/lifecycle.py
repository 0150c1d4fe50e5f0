"""Opening, writing and closing narratives as appends (LC2, LC7-LC9, LC13, SK2, ST3, ST5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_targets(requests: DataFrame, concepts: DataFrame) -> DataFrame:
    """LC7: request_id, target, verdict of the targets (array) of requests against concepts (name, status): ok, missing or inactive.

    Names are compared without regard to case; a target named twice counts once.
    """
    wanted = requests.select("request_id", F.explode(F.array_distinct("targets")).alias("target"))
    c = concepts.select(F.lower("name").alias("key"), (F.coalesce("status", F.lit("active")) == "active").alias("live")).groupBy("key").agg(F.max("live").alias("live"))
    j = wanted.join(c, F.lower("target") == F.col("key"), "left")
    return j.select("request_id", "target", F.when(F.col("live").isNull(), "missing").when(F.col("live"), "ok").otherwise("inactive").alias("verdict"))


def route_entry(entries: DataFrame, narratives: DataFrame) -> DataFrame:
    """LC8: entry_id, concepts, verdict: a narrative's only target is inherited; concepts outside its targets are refused."""
    j = entries.join(narratives.select("narrative", F.array_distinct("targets").alias("targets")), "narrative", "left")
    asked = F.array_distinct(F.coalesce("requested", F.array().cast("array<string>")))
    targets = F.coalesce("targets", F.array().cast("array<string>"))
    verdict = F.when(F.size(asked) == 0, F.when(F.size(targets) == 1, "inherited").when(F.size(targets) == 0, "free").otherwise("ambiguous")).when((F.size(targets) == 0) | (F.size(F.array_except(asked, targets)) == 0), "ok").otherwise("outside")
    return j.select("entry_id", F.when(verdict == "inherited", targets).otherwise(asked).alias("concepts"), verdict.alias("verdict"))


def close_plan(entries: DataFrame, current: DataFrame) -> DataFrame:
    """LC9, LC10: of each concept with entries (concept_id, entry_id, position): what a close does.

    current: concept_id, chunk_id, base_chunk_id (the one the narrative started from). Without a current chunk a
    concept is created; where base and current differ, three versions must be merged; else it is updated.
    """
    g = entries.groupBy("concept_id").agg(F.count("*").alias("n_entries"), F.min_by("entry_id", F.struct("position", "entry_id")).alias("first_entry"))
    j = g.join(current, "concept_id", "left")
    action = F.when(F.col("chunk_id").isNull(), "create").when(F.col("base_chunk_id").isNotNull() & (F.col("base_chunk_id") != F.col("chunk_id")), "merge").otherwise("update")
    return j.select("concept_id", "n_entries", "first_entry", "chunk_id", action.alias("action"))


def next_tree(tree: DataFrame, written: DataFrame) -> DataFrame:
    """LC2: the tree (concept_id, chunk_id) of the next commit: what was written replaces, the rest stays, null removes."""
    w = written.select("concept_id", F.col("chunk_id").alias("new"), F.lit(True).alias("hit"))
    j = tree.join(w, "concept_id", "full_outer")
    return j.select("concept_id", F.when(F.col("hit"), F.col("new")).otherwise(F.col("chunk_id")).alias("chunk_id")).where("chunk_id is not null")


def superseded_by(chunks: DataFrame, key: str, supersedes: str, at: str) -> DataFrame:
    """SK2: each chunk with the first chunk that supersedes it."""
    w = Window.partitionBy(supersedes).orderBy(at, key)
    s = chunks.where(F.col(supersedes).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col(supersedes).alias("__k"), F.col(key).alias("superseded_by"))
    return chunks.join(s, F.col(key) == F.col("__k"), "left").drop("__k")


def discard(narratives: DataFrame, names: list[str], seq: Column) -> DataFrame:
    """LC13: the next versions of open narratives that are given up."""
    return narratives.where(F.col("narrative").isin(names) & F.col("status").isin("open", "close_failed")).withColumn("status", F.lit("discarded")).withColumn("seq", seq)
