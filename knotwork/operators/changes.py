"""Changes of a graph as appended versions: lifecycle, patches, rescans, caches, work (LC3, LC10, LC12, LC13, QU5, RT19, SC11-SC13, SK5, SK6, ST2)."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.hierarchy import hierarchy

# The wait between two looks for work, the least one, and how far an ancestry is walked.
POLL_MS, LEAST_POLL_MS, WALK = 250, 50, 50


# lifecycle


def archived(concepts: DataFrame, ids: DataFrame, reason: Column, now: Column) -> DataFrame:
    """LC12: the next versions of active concepts (id, lifecycle_status, ...) that are archived; others named in ids (id) stay as they are."""
    c = concepts.join(ids.select("id").distinct(), "id", "left_semi").where(F.coalesce("lifecycle_status", F.lit("active")) == "active")
    return c.withColumn("lifecycle_status", F.lit("archived")).withColumn("lifecycle_reason", reason).withColumn("archived_at", now)


def restored(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """LC12: the next versions of archived or merged concepts that become active again."""
    c = concepts.join(ids.select("id").distinct(), "id", "left_semi").where(F.coalesce("lifecycle_status", F.lit("active")) != "active")
    none = lambda c_: F.lit(None).cast(concepts.schema[c_].dataType)
    return c.withColumn("lifecycle_status", F.lit("active")).withColumn("lifecycle_reason", none("lifecycle_reason")).withColumn("archived_at", none("archived_at")).withColumn("merged_into_concept_id", none("merged_into_concept_id"))


def merged_into(concepts: DataFrame, merges: DataFrame, now: Column) -> DataFrame:
    """LC12: the next versions of concepts that merges (from_id, to_id) put into others; one into itself, into an absent or inactive one, is refused; of several targets the smallest."""
    live = concepts.where(F.coalesce("lifecycle_status", F.lit("active")) == "active")
    m = merges.where("from_id <> to_id").join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("__to"))
    out = live.join(m, "id").withColumn("lifecycle_status", F.lit("merged")).withColumn("archived_at", now)
    return out.withColumn("lifecycle_reason", F.concat(F.lit("merged into "), "__to")).withColumn("merged_into_concept_id", F.col("__to")).drop("__to")


def rebound(bindings: DataFrame, merges: DataFrame) -> DataFrame:
    """LC12: bindings (concept_id, symbol_id, confidence) after merges (from_id, to_id): those of merged concepts go to their targets, of a pair the greater confidence stays."""
    m = merges.where("from_id <> to_id").groupBy(F.col("from_id").alias("concept_id")).agg(F.min("to_id").alias("__to"))
    b = bindings.join(m, "concept_id", "left").select(F.coalesce("__to", "concept_id").alias("concept_id"), "symbol_id", "confidence")
    return b.groupBy("concept_id", "symbol_id").agg(F.max("confidence").alias("confidence"))


def split_off(concepts: DataFrame, parts: DataFrame, now: Column) -> DataFrame:
    """LC12: first versions of the concepts that parts (from_id, new_id, name) split off: as their origin, active, at now; parts of absent concepts are left out."""
    p = parts.join(concepts.withColumnRenamed("id", "from_id").drop("name"), "from_id")
    return p.withColumn("lifecycle_status", F.lit("active")).withColumn("lifecycle_reason", F.concat(F.lit("split from "), "from_id")).withColumn("inserted_at", now).withColumnRenamed("new_id", "id").drop("from_id").select(*concepts.columns)


def designated(entries: DataFrame, designations: DataFrame) -> DataFrame:
    """LC13: entries (entry_id, narrative, concepts) with the concepts that designations (entry_id, narrative, concepts) give them; unknown entries are left out."""
    d = designations.groupBy("entry_id", "narrative").agg(F.max(F.struct(F.array_sort(F.array_distinct("concepts")).alias("c")))["c"].alias("__new"))
    return entries.join(d, ["entry_id", "narrative"], "left").withColumn("concepts", F.coalesce("__new", "concepts")).withColumn("designated", F.col("__new").isNotNull()).drop("__new")


def ancestry(commits: DataFrame, heads: DataFrame, most: int = WALK) -> DataFrame:
    """LC3: head, step, id of the commits (id, parent_id, both strings) from each head (id) back over their parents, step 0 the head; at most `most` of each.

    The parents are followed, whatever the times say; a head on or above a circle has none.
    """
    solved = hierarchy(commits.sparkSession, commits.select("id", F.col("parent_id").alias("parent")), True)
    path = F.slice(F.reverse("path"), 1, most)
    return solved.join(heads.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("head"), F.posexplode(path).alias("step", "id"))


# patches


def parse_ops(raw: str | None) -> list[dict] | None:
    """LC10: the patch operations in a text: the array of objects that it holds; None if one is no valid operation."""
    found = re.search(r"\[.*\]", raw or "", re.S)
    try:
        ops = json.loads(found.group()) if found else None
    except ValueError:
        return None
    if not isinstance(ops, list):
        return None
    needs = {"replace": ("block_id", "content"), "delete": ("block_id",), "insert_after": ("block_id", "content"), "append": ("content",)}
    good = all(isinstance(o, dict) and o.get("op") in needs and all(isinstance(o.get(f), str) for f in needs[o["op"]]) for o in ops)
    return ops if good else None


def apply_ops(content: str, ops: list[dict] | None) -> str | None:
    """LC10: the blocks of a text (parted by empty lines, named block-1, block-2, ...) after the operations; None where they can't be applied or nothing is left."""
    if ops is None:
        return None
    blocks: list[tuple[str, str]] = [(f"block-{i + 1}", b.strip()) for i, b in enumerate(x for x in re.split(r"\n\s*\n", content) if x.strip())]
    for o in ops:
        text = o.get("content", "").strip()
        at = next((i for i, (name, _) in enumerate(blocks) if name == o.get("block_id")), None)
        if o["op"] == "append":
            blocks += [("", text)] if text else []
        elif at is None or o["op"] == "replace" and not text:
            return None
        elif o["op"] == "delete":
            del blocks[at]
        elif o["op"] == "replace":
            blocks[at] = (blocks[at][0], text)
        elif text:
            blocks.insert(at + 1, ("", text))
    return "\n\n".join(b for _, b in blocks).strip() or None


def patched(texts: DataFrame, key: str) -> DataFrame:
    """LC10: key, content, way of texts (key, content, ops, rewrite): 'patch', or 'rewrite' where the operations fail and a rewrite is given, else 'kept'."""

    def one(content: str | None, ops: str | None, rewrite: str | None) -> tuple[str | None, str]:
        new = apply_ops(content or "", parse_ops(ops))
        return (new, "patch") if new is not None else (rewrite, "rewrite") if rewrite else (content, "kept")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *one(c, o, r)) for k, c, o, r in b.itertuples(index=False)], columns=[key, "content", "way"])

    rows = texts.select(key, "content", "ops", "rewrite")
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, content string, way string")


# rescans


def rescan(stored: DataFrame, found: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """SC11-SC13: file_path, action (add, change, remove, skip) of files by their digest (file_path, digest); with paths (file_path) of these alone."""
    s, f = (d if paths is None else d.join(paths.select("file_path").distinct(), "file_path", "left_semi") for d in (stored, found))
    j = s.select("file_path", F.col("digest").alias("old"), F.lit(True).alias("was")).join(f.select("file_path", F.col("digest").alias("new"), F.lit(True).alias("now")), "file_path", "full_outer")
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("old").eqNullSafe(F.col("new")), "skip").otherwise("change")
    return j.select("file_path", action.alias("action"))


def reattached(bindings: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """SC11: concept_id, symbol_id, binding_type, confidence, bound_body_hash, old_symbol_id: bindings of replaced symbols at the new symbols of the same file and qualified name.

    old, new: symbol_id, source_file_id, qualified_name, new also body_hash. What has no counterpart is lost, as a replaced file
    loses it; of bindings that meet at one new symbol and concept the most trusted stays.
    """
    o = old.select("symbol_id", "source_file_id", "qualified_name").where("qualified_name is not null")
    n = new.select(F.col("symbol_id").alias("new_id"), "source_file_id", "qualified_name", "body_hash")
    j = bindings.join(o, "symbol_id").join(n, ["source_file_id", "qualified_name"])
    best = j.groupBy("concept_id", "new_id").agg(F.max(F.struct("confidence", "symbol_id", "binding_type", "body_hash")).alias("b"))
    return best.select("concept_id", F.col("new_id").alias("symbol_id"), "b.binding_type", "b.confidence", F.col("b.body_hash").alias("bound_body_hash"), F.col("b.symbol_id").alias("old_symbol_id"))


def relations_upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """SK5: relations (from_id, to_id, relation_type, weight, active, at) after an upsert: an incoming one is active, its weight between 0 and 1, 1 if it is not finite."""
    w = F.col("weight")
    clean = incoming.withColumn("weight", F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))).withColumn("active", F.lit(1))
    both = existing.select(*clean.columns).withColumn("__new", F.lit(0)).unionByName(clean.withColumn("__new", F.lit(1)))
    rest = [c for c in clean.columns if c not in ("from_id", "to_id", "relation_type")]
    best = both.groupBy("from_id", "to_id", "relation_type").agg(F.max(F.struct("__new", "at", *[c for c in rest if c != "at"])).alias("r"))
    return best.select("from_id", "to_id", "relation_type", *[f"r.{c}" for c in rest])


# caches and work


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """RT19: the cache with new answers (id, query_text, result_json, created_at, expires_at); an id that is there already is refused."""
    fresh = rows.join(cache.select("id"), "id", "left_anti").withColumn("score", F.lit(None).cast("double")).withColumn("scored_by", F.lit(None).cast("string"))
    return cache.select(*fresh.columns).unionByName(fresh)


def cache_scored(cache: DataFrame, scores: DataFrame) -> DataFrame:
    """RT19: the cache after scores (id, score, scored_by, at): the latest of an id counts, scored_by is 'agent' if it is null; unknown ids change nothing."""
    s = scores.groupBy("id").agg(F.max(F.struct("at", "score", F.coalesce("scored_by", F.lit("agent")).alias("scored_by"))).alias("s"))
    j = cache.join(s, "id", "left")
    return j.withColumn("score", F.coalesce("s.score", "score")).withColumn("scored_by", F.coalesce("s.scored_by", "scored_by")).drop("s")


def cache_pruned(cache: DataFrame, now: Column) -> DataFrame:
    """RT19: what has not expired; without an expiry an answer stays."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def work(claim: Callable[[], object | None], handle: Callable[[object], None], poll_ms: int = POLL_MS, max_idle: int | None = None, max_jobs: int | None = None, tell: Callable[[str, object], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """QU5, UD5: claims jobs and handles them one after the other until max_jobs are done or max_idle looks in a row found none.

    A job that raises counts as failed and the work goes on; tell hears of every step. The wait is never under LEAST_POLL_MS.
    """
    done = {"handled": 0, "failed": 0, "idle": 0}
    in_a_row = 0
    while max_jobs is None or done["handled"] + done["failed"] < max_jobs:
        job = claim()
        if job is None:
            done["idle"] += 1
            in_a_row += 1
            if max_idle is not None and in_a_row >= max_idle:
                break
            sleep(max(LEAST_POLL_MS, poll_ms) / 1000)
            continue
        in_a_row = 0
        try:
            handle(job)
            done["handled"] += 1
            said = "handled"
        except Exception as e:  # noqa: BLE001  a job's fault is not the worker's
            done["failed"] += 1
            said = f"failed: {type(e).__name__}"
        if tell:
            tell(said, job)
    return done


def write_trace(events: DataFrame, path: str) -> None:
    """SK6: the events of questions as lines of JSON, one folder a day (column at)."""
    events.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(path)


def unique_sites(sites: DataFrame) -> DataFrame:
    """ST2: call sites once for each file, line, caller and callee: of repeated ones the smallest snippet."""
    return sites.groupBy("file", "line", "caller", "callee").agg(F.min("snippet").alias("snippet"))
