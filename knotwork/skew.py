"""Joins in which a few keys hold very many rows of one side.

A key is hot if it has more than a 256th of all rows; there can be no more than 255 of them, so their
list has a proven bound and may go to the driver and into a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE, SALTS, LEAST = 256, 32, 20_000


def hot_values(df: DataFrame, key: str, n: str | None = None, least: int = LEAST) -> list:
    """The hot values of key; n: column with the number of rows that a row of df stands for."""
    counts = df.groupBy(key).agg((F.sum(n) if n else F.count("*")).alias("__n"))
    big = counts.where(F.col("__n") > least)
    found = big.orderBy(F.desc("__n")).limit(SHARE).collect()
    if not found:
        return []
    total = df.agg(F.sum(n) if n else F.count("*")).first()[0]
    return [r[key] for r in found if r["__n"] > total / SHARE]


def salted(df: DataFrame, key: str, hot: list, by: Column | str) -> DataFrame:
    """The large side: rows of hot keys get one of SALTS numbers in __salt, all others 0."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    return df.withColumn("__salt", F.when(F.col(key).isin(hot), salt).otherwise(0) if hot else F.lit(0))


def spread(df: DataFrame, key: str, hot: list) -> DataFrame:
    """The side with one row a key: rows of hot keys are there for each salt."""
    if not hot:
        return df.withColumn("__salt", F.lit(0))
    return df.withColumn("__salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
