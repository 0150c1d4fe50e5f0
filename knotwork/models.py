"""Hooks for external models, with deterministic stand-ins (UD1-UD4, RT9, RT18, SF22 fallbacks)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def segment(self, text: str) -> list[str]: ...

    def merge(self, base: str, mine: str, theirs: str) -> str: ...


class HashingEmbedder:
    """Words hashed into dim signed places, unit length; the zero vector of a text without words."""

    def __init__(self, dim: int = 64):
        self.model, self.dim = f"hashing-{dim}", dim

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0).tolist()


class PlainGenerator:
    """Paragraphs as segments; a merge that keeps what only one side changed and lists both where both did."""

    def segment(self, text: str) -> list[str]:
        return [p.strip() for p in re.split(r"\n\s*\n", text or "") if p.strip()]

    def merge(self, base: str, mine: str, theirs: str) -> str:
        return theirs if mine == base else mine if theirs in (base, mine) else f"{mine.rstrip()}\n\n{theirs.lstrip()}"


def embed(texts: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 96) -> DataFrame:
    """UD2, LC15: key, model, embedding of every text, batch texts a call; a null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "model": embedder.model, "embedding": embedder.embed_batch([t or "" for t in part[text]])})

    rows = texts.select(key, text)
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, model string, embedding array<float>")


def register_sql_functions(spark: SparkSession) -> None:
    """UD1: vec_distance_cosine(a, b) in SQL, as an expression that the optimizer sees; 1 if a vector is zero."""
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    n = f"sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_distance_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - coalesce(try_divide({dot.format('a', 'b')}, {n}), 0)")


def rerank(results: DataFrame, scores: DataFrame | None, key: str, window: int = 20, query: str | None = None, least: int = 8) -> DataFrame:
    """RT9, UD4: the first window of results (key, score, pos from 0) in the order of a reranker's scores (key, new), the rest behind them.

    Nothing changes without scores, for a query of fewer than least characters, or where there is but one result. New scores stand
    only where the order did change; results of the window without one come last in it, with a score of 0.
    """
    if scores is None or query is not None and len(query.strip()) < least:
        return results
    head = F.col("pos") < window
    order = Window.orderBy((~F.col("head")).cast("int"), F.col("new").desc_nulls_last(), "pos")  # a page of results
    j = results.withColumn("head", head).join(scores.select(key, "new"), key, "left").withColumn("new", F.when(F.col("head"), F.col("new")))
    j = j.withColumn("to", F.row_number().over(order) - 1)
    one = j.agg(F.max(F.col("head") & (F.col("to") != F.col("pos"))).alias("moved"))
    j = j.join(F.broadcast(one))  # one row
    score = F.when(F.col("moved") & F.col("head"), F.coalesce("new", F.lit(0.0))).otherwise(F.col("score"))
    pos = F.when(F.col("moved"), F.col("to")).otherwise(F.col("pos"))
    return j.withColumn("score", score).withColumn("pos", pos.cast(results.schema["pos"].dataType)).drop("head", "new", "to", "moved")
