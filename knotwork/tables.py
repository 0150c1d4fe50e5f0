"""Reading tables and the spelling rules that all references share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outer characters that never belong to a reference, a code or a status.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0  　﻿"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trimmed(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(BLANKS))


def ref_key(c: Column | str) -> Column:
    """A reference without outer blanks in upper case; null if nothing is left."""
    return F.nullif(F.upper(_trimmed(c)), F.lit(""))


def code_key(c: Column | str) -> Column:
    """A code (model, source, language, status) without outer blanks in lower case; null if nothing is left."""
    return F.nullif(F.lower(_trimmed(c)), F.lit(""))


def ref_sql(expr: str) -> str:
    """The DuckDB text of ref_key."""
    return f"nullif(upper(trim({expr}, '{BLANKS}')), '')"


def code_sql(expr: str) -> str:
    """The DuckDB text of code_key."""
    return f"nullif(lower(trim({expr}, '{BLANKS}')), '')"


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00, whatever the session's time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)
