"""Bindings between concepts and symbols: coverage, drift and summaries (JN4-JN10, AG3-AG9, HS7, HS16).

bindings: concept_id, symbol_id, binding_type, bound_body_hash, confidence, updated_at; symbols: id,
source_file_id, name, qualified_name, kind, body_hash, export_status, signature; files: id, file_path,
language, symbol_count; concepts: id, name. Ids must be spelled alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORTED = ("exported", "default_export")


def drifted(bindings: DataFrame, symbols: DataFrame, files: DataFrame, concepts: DataFrame) -> DataFrame:
    """JN4, PF5: bindings whose symbol's body is no longer the bound one; both hashes must be known."""
    b = bindings.where("bound_body_hash is not null").select("concept_id", "symbol_id", "bound_body_hash", "confidence")
    s = symbols.where("body_hash is not null").select(F.col("id").alias("symbol_id"), "name", "body_hash", "source_file_id")
    f = files.select(F.col("id").alias("source_file_id"), "file_path")
    c = concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("concept"))
    return b.join(s, "symbol_id").where("bound_body_hash <> body_hash").join(f, "source_file_id").join(c, "concept_id", "left").select("concept_id", "concept", "symbol_id", F.col("name").alias("symbol"), "file_path", "confidence")


def drift_scores(drift: DataFrame) -> DataFrame:
    """HS7: .5 for one drifted binding, .7 for two, .85 for three and four, 1 from five on."""
    n = F.col("n_drifted")
    score = F.when(n >= 5, 1.0).when(n >= 3, 0.85).when(n >= 2, 0.7).otherwise(0.5)
    return drift.groupBy("concept_id").agg(F.count("*").alias("n_drifted")).withColumn("score", score)


def summaries(bindings: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """JN5."""
    s = symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "source_file_id")
    f = files.select(F.col("id").alias("source_file_id"), "file_path")
    return bindings.select("concept_id", "symbol_id", "binding_type", "confidence").join(s, "symbol_id").join(f, "source_file_id").select("concept_id", "symbol_id", F.col("name").alias("symbol"), "kind", "file_path", "binding_type", "confidence")


def uncovered(bindings: DataFrame, symbols: DataFrame, files: DataFrame, exported_only: bool = False) -> DataFrame:
    """JN7, PF7: symbols that nothing is bound to."""
    s = symbols.where(F.col("export_status").isin(*EXPORTED)) if exported_only else symbols
    bound = bindings.where("symbol_id is not null").select(F.col("symbol_id").alias("id")).distinct()
    f = files.select(F.col("id").alias("source_file_id"), "file_path")
    return s.join(bound, "id", "left_anti").join(f, "source_file_id").select(F.col("id").alias("symbol_id"), "name", "kind", "export_status", "file_path")


def kept_bindings(bindings: DataFrame, symbols: DataFrame, concepts: DataFrame) -> DataFrame:
    """JN8: bindings whose symbol and concept exist; archived concepts do."""
    s, c = symbols.select(F.col("id").alias("symbol_id")).distinct(), concepts.select(F.col("id").alias("concept_id")).distinct()
    return bindings.join(s, "symbol_id", "left_semi").join(c, "concept_id", "left_semi")


def concept_coverage(bindings: DataFrame, symbols: DataFrame, concepts: DataFrame) -> DataFrame:
    """JN9, JN10, AG6: symbols bound to a concept, symbols in the files it is bound to, and what is left to bind.

    A concept's files are few against all symbols of a file, so (concept, file) pairs are made distinct
    before they meet the per-file counts: no row is multiplied.
    """
    s = symbols.select(F.col("id").alias("symbol_id"), "source_file_id")
    bound = bindings.select("concept_id", "symbol_id").distinct()
    per_file = s.groupBy("source_file_id").agg(F.count("*").alias("n"))
    reach = bound.join(s, "symbol_id").select("concept_id", "source_file_id").distinct().join(per_file, "source_file_id").groupBy("concept_id").agg(F.sum("n").alias("reachable"))
    counts = bound.groupBy("concept_id").agg(F.count("*").alias("bound"))
    out = concepts.select(F.col("id").alias("concept_id"), "name").join(counts, "concept_id", "left").join(reach, "concept_id", "left").na.fill(0, ["bound", "reachable"])
    capacity = F.when(F.col("bound") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("bound").cast("double"), F.col("reachable"))))
    return out.withColumn("capacity", F.coalesce(capacity, F.lit(0.0)))


def file_coverage(bindings: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """AG5: binding rows of a file's symbols against its symbol count; the ratio may exceed 1."""
    b = bindings.select("symbol_id").join(symbols.select(F.col("id").alias("symbol_id"), "source_file_id"), "symbol_id").groupBy("source_file_id").agg(F.count("*").alias("bound_count"))
    f = files.select(F.col("id").alias("source_file_id"), "file_path", "language", "symbol_count")
    out = f.join(b, "source_file_id", "left").na.fill(0, ["bound_count"])
    return out.withColumn("ratio", F.when(F.col("symbol_count") > 0, F.col("bound_count") / F.col("symbol_count")).otherwise(0.0)).drop("source_file_id")


def coverage_stats(bindings: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """AG4: one row: exported symbols and those bound, files and those with a bound symbol."""
    bound = bindings.where("symbol_id is not null").select(F.col("symbol_id").alias("id"), F.lit(1).alias("is_bound")).distinct()
    s = symbols.join(bound, "id", "left")
    exported = F.col("export_status").isin(*EXPORTED)
    sums = s.agg(F.count_if(exported).alias("total_exported"), F.count_if(exported & F.col("is_bound").isNotNull()).alias("bound_exported"), F.countDistinct(F.when(F.col("is_bound").isNotNull(), F.col("source_file_id"))).alias("files_with_bindings"))
    return sums.join(F.broadcast(files.agg(F.count("*").alias("total_files"))))


def binding_counts(bindings: DataFrame) -> DataFrame:
    """AG3, AG9: one row of counts by type, distinct ends and mean confidence."""
    t = F.col("binding_type")
    return bindings.agg(
        F.count("*").alias("total"),
        *[F.count_if(t == k).alias(k.replace("-", "_")) for k in ("manual", "mention", "file-overlap", "semantic")],
        F.countDistinct("concept_id").alias("concepts"),
        F.countDistinct("symbol_id").alias("symbols"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )
