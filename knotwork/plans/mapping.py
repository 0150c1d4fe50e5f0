"""The engine's logical tables in terms of the test tables, each as a DataFrame and as DuckDB text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators.views import latest
from knotwork.tables import code_key, code_sql, ref_key, ref_sql, table

#: The moment that stands for now, and the query that is asked.
NOW = "2026-01-01 00:00:00"
QUESTION = "Which narrative keeps the retryPath of the stale query cache?"
TERMS = ["which", "narrative", "keeps", "the", "retrypath", "retry", "path", "of", "stale", "query", "cache"]


def now() -> F.Column:
    return F.to_timestamp_ntz(F.lit(NOW))


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "concepts"), "id", "seq").withColumn("status", F.coalesce(code_key("lifecycle_status"), F.lit("active")))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "symbols"), "id", "scanned_at")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files")


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "concept_symbols").withColumn("concept_id", ref_key("concept_id")).withColumn("symbol_id", ref_key("symbol_id")).where("concept_id is not null and symbol_id is not null")
    w = Window.partitionBy("concept_id", "symbol_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc())
    return b.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """State chunks: id, concept, supersedes, status, created, vector of their own model."""
    s = table(spark, sf, "state_chunks")
    rest = [c for c in s.columns if c not in ("fl_id", "fl_created_at")]
    s = s.groupBy("fl_id").agg(F.max(F.struct("fl_created_at", *rest)).alias("r")).select("fl_id", "r.*")  # repeated rows: the latest, then the greatest
    return s.select(F.col("fl_id").alias("id"), ref_key("fl_concept_id").alias("concept_id"), ref_key("fl_supersedes").alias("supersedes_id"), code_key("fl_lifecycle_status").alias("status"), "fl_narrative_origin", "fl_created_at", "fl_residual", "fl_staleness", "fl_cluster")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", "text", "fl_type", code_key("source").alias("narrative"), "created_at")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations between nations: what customers of one bought from suppliers of another, as a share of the greatest."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c, s = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("from_id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("to_id"))
    sums = li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").groupBy("from_id", "to_id").agg(F.sum("l_quantity").alias("q"))
    most = sums.agg(F.max("q").alias("m"))
    return sums.join(F.broadcast(most)).select("from_id", "to_id", F.round(F.col("q") / F.col("m"), 6).alias("weight"), F.when(F.col("q") > 0.3 * F.col("m"), 1).otherwise(0).alias("active"))  # one row


def call_sites(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("caller"), (1_000_000 + F.col("l_partkey")).alias("callee"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as interactions: the user stands for the result and the subject."""
    kinds = {"view": "ask", "click": "show", "purchase": "recall", "signup": "open_narrative", "error": "close_narrative"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("result_id"), kind.alias("event_type"), F.col("user_id").alias("subject"), F.when(k % 2 == 0, "show").otherwise("recall").alias("primary_action"), (k % 3 == 0).alias("stale_warning"), F.col("ts").alias("at"), "value")


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line"), F.col("o_orderdate").alias("committed_at"))


def trees(spark: SparkSession, sf: str) -> DataFrame:
    """Of each commit the chunk of each concept; several lines of one supplier: the greatest part."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("concept_id")).agg(F.max("l_partkey").alias("chunk_id"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "leased").otherwise("done")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("scope"), status.alias("status"), (F.col("o_orderkey") % 3).alias("attempt"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_expires_at"), F.col("o_orderdate").alias("updated_at"))


def terms_of(text: str) -> list[str]:
    """query_terms() of a literal."""
    out: dict[str, None] = {}
    for t in text.split():
        parts = [p for p in re.sub("([A-Z])", r" \1", t).split(" ") if p]
        for x in [t, *([p.lower() for p in parts] if len(parts) > 1 else [])]:
            out.update(dict.fromkeys(w for w in re.split("[^a-z0-9]+", x.lower()) if w))
    return list(out)


_KINDS = "CASE event_type WHEN 'view' THEN 'ask' WHEN 'click' THEN 'show' WHEN 'purchase' THEN 'recall' WHEN 'signup' THEN 'open_narrative' WHEN 'error' THEN 'close_narrative' END"
SQL = {
    "cur": f"cur AS (SELECT *, coalesce({code_sql('lifecycle_status')}, 'active') AS status FROM concepts QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)",
    "sym": "sym AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)",
    "bind": f"bind AS (SELECT * FROM (SELECT * REPLACE ({ref_sql('concept_id')} AS concept_id, {ref_sql('symbol_id')} AS symbol_id) FROM concept_symbols) WHERE concept_id IS NOT NULL AND symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY concept_id, symbol_id ORDER BY updated_at DESC NULLS LAST, id DESC) = 1)",
    "chunks": f"chunks AS (SELECT fl_id AS id, {ref_sql('fl_concept_id')} AS concept_id, {ref_sql('fl_supersedes')} AS supersedes_id, {code_sql('fl_lifecycle_status')} AS status, fl_narrative_origin, fl_created_at, fl_residual, fl_staleness, fl_cluster FROM state_chunks QUALIFY row_number() OVER (PARTITION BY fl_id ORDER BY fl_created_at DESC NULLS LAST, fl_type DESC NULLS LAST, fl_concept DESC NULLS LAST, fl_concept_id DESC NULLS LAST, fl_supersedes DESC NULLS LAST, fl_superseded_by DESC NULLS LAST, fl_narrative_origin DESC NULLS LAST, fl_version DESC NULLS LAST, fl_residual DESC NULLS LAST, fl_staleness DESC NULLS LAST, fl_cluster DESC NULLS LAST) = 1)",
    "docs": f"docs AS (SELECT doc_id, text, fl_type, {code_sql('source')} AS narrative, created_at FROM documents)",
    "rel": "sums AS (SELECT c_nationkey AS from_id, s_nationkey AS to_id, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), rel AS (SELECT from_id, to_id, round(q / (SELECT max(q) FROM sums), 6) AS weight, CASE WHEN q > 0.3 * (SELECT max(q) FROM sums) THEN 1 ELSE 0 END AS active FROM sums)",
    "sites": "sites AS (SELECT l_suppkey AS caller, 1000000 + l_partkey AS callee, l_orderkey AS file, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS place FROM lineitem)",
    "ev": f"ev AS (SELECT event_id, user_id AS result_id, {_KINDS} AS event_type, user_id AS subject, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'show' ELSE 'recall' END AS primary_action, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 AS stale_warning, ts AS tm, value FROM events)",
    "com": "com AS (SELECT o_orderkey AS id, o_custkey AS line, o_orderdate AS committed_at FROM orders)",
    "tree": "tree AS (SELECT l_orderkey AS commit_id, l_suppkey AS concept_id, max(l_partkey) AS chunk_id FROM lineitem GROUP BY 1, 2)",
    "jobs": "jobs AS (SELECT o_orderkey AS id, o_orderpriority AS scope, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'leased' ELSE 'done' END AS status, o_orderkey % 3 AS attempt, o_orderdate + INTERVAL 30 DAY AS lease_expires_at, o_orderdate AS updated_at FROM orders)",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
