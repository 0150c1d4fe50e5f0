"""Queries of the general data problems 3, 4 and 7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.hierarchy import descendants, described, hierarchy
from knotwork.operators.history import history_of_versions
from knotwork.operators.orphans import NEVER, orphans
from knotwork.tables import code_key, code_sql, micros, ref_key, ref_sql, table


def _history(spark: SparkSession, sf: str) -> DataFrame:
    attrs = {"status": F.coalesce(code_key("lifecycle_status"), F.lit("active")), "residual": F.round("residual", 4)}
    return history_of_versions(table(spark, sf, "concepts"), "id", "version_id", "inserted_at", "seq", attrs)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select(F.col("id").alias("concept_id"), "version_id", micros("valid_from").alias("valid_from_us"), F.coalesce(micros("valid_to"), F.lit(-1)).cast("long").alias("valid_to_us"))


def p3_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history with the state that held in each period."""
    return _history(spark, sf).select(F.col("id").alias("concept_id"), "version_id", "status", "residual", micros("valid_from").alias("valid_from_us"), F.coalesce(micros("valid_to"), F.lit(-1)).cast("long").alias("valid_to_us"))


def latest_rows(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """Of the rows of each key the one with the latest at; among equals the greatest values, so that repeats don't matter."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.struct(F.col(at).alias("at"), *[F.col(c).alias(c) for c in columns])).alias("r")).select("id", "r.*")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "concept_symbols")
    refs = b.select(F.col("id").alias("row_id"), F.col("created_at").alias("at"), F.explode(F.create_map(F.lit("concept_id"), ref_key("concept_id"), F.lit("symbol_id"), ref_key("symbol_id"))).alias("field", "key"))
    concepts = table(spark, sf, "concepts").select(F.lit("concept_id").alias("field"), ref_key("id").alias("key"), F.col("inserted_at").alias("since"))
    concepts = concepts.groupBy("field", "key").agg(F.min("since").alias("since")).withColumn("alive", F.lit(True))
    builtin = table(spark, sf, "builtin_concepts").select(F.lit("concept_id").alias("field"), ref_key("concept_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(True).alias("alive"))
    symbols = table(spark, sf, "symbols").select(ref_key("id").alias("key"), "scanned_at", F.col("removed_at").isNotNull().alias("removed"))
    symbols = symbols.groupBy("key").agg(F.min("scanned_at").alias("since"), F.max(F.struct("scanned_at", "removed"))["removed"].alias("removed"))
    symbols = symbols.select(F.lit("symbol_id").alias("field"), "key", "since", (~F.col("removed")).alias("alive"))
    return orphans(spark, refs, concepts.unionByName(builtin).unionByName(symbols))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select(F.col("row_id").alias("binding_id"), F.col("field").alias("ref_field"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references counted per field and month of created_at (yyyymm, null if it has none)."""
    return _orphans(spark, sf).groupBy(F.col("field").alias("ref_field"), F.when(F.col("period") != NEVER, F.col("period")).alias("month")).agg(F.count("*").alias("n_orphans"))


def _symbol_nodes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "symbols").select(ref_key("id").alias("id"), ref_key("parent_id").alias("parent"), "scanned_at")
    return latest_rows(s, "id", "scanned_at", "parent")


def _chunk_nodes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "state_chunks").select(ref_key("fl_id").alias("id"), ref_key("fl_supersedes").alias("parent"), "fl_created_at")
    return latest_rows(s, "id", "fl_created_at", "parent")


#: Symbols and chunks are solved together: their ids get a letter in front, so that they can't meet.
def _both(spark: SparkSession, sf: str, paths: bool) -> DataFrame:
    tag = lambda df, t: df.select(F.concat(F.lit(t), "id").alias("id"), F.concat(F.lit(t), "parent").alias("parent"))
    return hierarchy(spark, tag(_symbol_nodes(spark, sf), "s").unionByName(tag(_chunk_nodes(spark, sf), "c")), paths)


def _node_table(c: str) -> F.Column:
    return F.when(F.substring(c, 1, 1) == "s", "symbols").otherwise("state_chunks")


def _bare(c: str) -> F.Column:
    return F.expr(f"substring({c}, 2)")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, False).select(_node_table("id").alias("node_table"), _bare("id").alias("node_id"), _bare("root_id").alias("root_id"), "depth")


def p7_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node."""
    d = described(_both(spark, sf, True))
    return d.select(_node_table("id").alias("node_table"), _bare("id").alias("node_id"), _bare("root_id").alias("root_id"), "depth", F.array_join(F.expr("transform(path, x -> substring(x, 2))"), "/").alias("path"), "n_descendants")


def p7_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every node below every node, with the distance."""
    d = descendants(_both(spark, sf, True))
    return d.select(_node_table("ancestor").alias("node_table"), _bare("ancestor").alias("ancestor_id"), _bare("descendant").alias("descendant_id"), "distance")


def p7_circles(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes whose links run in circles, or lead into one."""
    return p7_found(spark, sf).where("depth < 0").select("node_table", "node_id")


QUERIES = {"p3_found": p3_found, "p3_history": p3_history, "p4_found": p4_found, "p4_report": p4_report, "p7_found": p7_found, "p7_hierarchy": p7_hierarchy, "p7_descendants": p7_descendants, "p7_circles": p7_circles}

_STATES = f"""
WITH counted AS (SELECT * FROM concepts QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY seq DESC) = 1),
states AS (SELECT id, version_id, inserted_at, coalesce({code_sql('lifecycle_status')}, 'active') AS status, round(residual, 4) AS residual
  FROM counted QUALIFY row_number() OVER (PARTITION BY id, inserted_at ORDER BY seq DESC) = 1),
marked AS (SELECT *, lag(status) OVER w IS DISTINCT FROM status OR lag(residual) OVER w IS DISTINCT FROM residual OR row_number() OVER w = 1 AS begins
  FROM states WINDOW w AS (PARTITION BY id ORDER BY inserted_at)),
periods AS (SELECT id AS concept_id, version_id, status, residual, epoch_us(inserted_at) AS valid_from_us,
  coalesce(lead(epoch_us(inserted_at)) OVER (PARTITION BY id ORDER BY inserted_at), -1) AS valid_to_us FROM marked WHERE begins)
"""
_ORPHANS = f"""
WITH c AS (SELECT {ref_sql('id')} AS k, min(inserted_at) AS since FROM concepts GROUP BY 1
  UNION ALL SELECT {ref_sql('concept_id')}, NULL FROM builtin_concepts),
cc AS (SELECT k, CASE WHEN count(since) = count(*) THEN min(since) END AS since FROM c GROUP BY 1),
s AS (SELECT {ref_sql('id')} AS k, min(scanned_at) AS since, arg_max(removed_at IS NOT NULL, scanned_at) AS removed FROM symbols GROUP BY 1),
found AS (
  SELECT b.id AS binding_id, 'concept_id' AS ref_field, b.created_at FROM concept_symbols b LEFT JOIN cc ON {ref_sql('b.concept_id')} = cc.k
  WHERE {ref_sql('b.concept_id')} IS NOT NULL AND (cc.k IS NULL OR cc.since > b.created_at)
  UNION SELECT b.id, 'symbol_id', b.created_at FROM concept_symbols b LEFT JOIN s ON {ref_sql('b.symbol_id')} = s.k
  WHERE {ref_sql('b.symbol_id')} IS NOT NULL AND (s.k IS NULL OR s.removed OR s.since > b.created_at))
"""
_TREES = f"""
WITH RECURSIVE nodes AS (
  SELECT 'symbols' AS node_table, {ref_sql('id')} AS id, (max(struct_pack(t := scanned_at, p := coalesce({ref_sql('parent_id')}, '')))).p AS parent FROM symbols GROUP BY 2
  UNION ALL
  SELECT 'state_chunks', {ref_sql('fl_id')}, (max(struct_pack(t := fl_created_at, p := coalesce({ref_sql('fl_supersedes')}, '')))).p FROM state_chunks GROUP BY 2),
walk AS (
  SELECT n.node_table, n.id, n.id AS root_id, 0 AS depth, n.id AS path FROM nodes n LEFT JOIN nodes m ON m.node_table = n.node_table AND m.id = n.parent WHERE m.id IS NULL
  UNION ALL
  SELECT n.node_table, n.id, w.root_id, w.depth + 1, w.path || '/' || n.id FROM walk w JOIN nodes n ON n.node_table = w.node_table AND n.parent = w.id),
solved AS (SELECT n.node_table, n.id AS node_id, coalesce(w.root_id, '') AS root_id, coalesce(w.depth, -1) AS depth, coalesce(w.path, '') AS path FROM nodes n LEFT JOIN walk w ON w.node_table = n.node_table AND w.id = n.id),
below AS (SELECT node_table, node_id AS descendant_id, depth, unnest(string_split(path, '/')) AS ancestor_id, unnest(generate_series(0, depth)) AS pos FROM solved WHERE depth > 0)
"""

ORACLES = {
    "p3_found": _STATES + "SELECT concept_id, version_id, valid_from_us, valid_to_us FROM periods",
    "p3_history": _STATES + "SELECT * FROM periods",
    "p4_found": _ORPHANS + "SELECT DISTINCT binding_id, ref_field FROM found",
    "p4_report": _ORPHANS + "SELECT ref_field, CAST(year(created_at) * 100 + month(created_at) AS INTEGER) AS month, count(DISTINCT binding_id) AS n_orphans FROM found GROUP BY 1, 2",
    "p7_found": _TREES + "SELECT node_table, node_id, root_id, depth FROM solved",
    "p7_hierarchy": _TREES + """SELECT s.node_table, s.node_id, s.root_id, s.depth, s.path, coalesce(b.n, 0) AS n_descendants FROM solved s
  LEFT JOIN (SELECT node_table, ancestor_id, count(*) AS n FROM below WHERE pos < depth GROUP BY 1, 2) b ON b.node_table = s.node_table AND b.ancestor_id = s.node_id""",
    "p7_descendants": _TREES + "SELECT node_table, ancestor_id, descendant_id, CAST(depth - pos AS INTEGER) AS distance FROM below WHERE pos < depth",
    "p7_circles": _TREES + "SELECT node_table, node_id FROM solved WHERE depth < 0",
}
