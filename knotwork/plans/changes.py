"""Queries of changes and of what summaries rest on, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators import changes as CH
from knotwork.operators import graph as G
from knotwork.operators import grounding as GR
from knotwork.operators import texts as T
from knotwork.plans import mapping as M
from knotwork.plans.mapping import NOW, QUESTION, with_
from knotwork.plans.registry import registry
from knotwork.plans.upkeep import rounded
from knotwork.tables import micros, ref_key, ref_sql, table

QUERIES, ORACLES, query = registry()


def _cur(spark: SparkSession, sf: str) -> DataFrame:
    return M.concepts(spark, sf).withColumn("lifecycle_status", F.col("status")).drop("status")


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """from_id, to_id: the merges that any version asks for."""
    return table(spark, sf, "concepts").select(F.col("id").alias("from_id"), ref_key("merged_into_concept_id").alias("to_id")).where("to_id is not null").distinct()


_TARGETS = f"mt AS (SELECT DISTINCT id AS from_id, {ref_sql('merged_into_concept_id')} AS to_id FROM concepts WHERE {ref_sql('merged_into_concept_id')} IS NOT NULL)"


@query(with_("cur") + f" SELECT id, 'archived' AS lifecycle_status, 'stale' AS lifecycle_reason, epoch_us(TIMESTAMP '{NOW}') AS archived_us FROM cur WHERE status = 'active' AND staleness > 0.7")
def lifecycle_archive(spark: SparkSession, sf: str) -> DataFrame:
    """LC12: the stale concepts are archived."""
    c = _cur(spark, sf)
    out = CH.archived(c, c.where("staleness > 0.7"), F.lit("stale"), M.now())
    return out.select("id", "lifecycle_status", "lifecycle_reason", micros("archived_at").alias("archived_us"))


@query(with_("cur") + " SELECT id, 'active' AS lifecycle_status, CAST(NULL AS VARCHAR) AS merged_into_concept_id FROM cur WHERE status <> 'active'")
def lifecycle_restore(spark: SparkSession, sf: str) -> DataFrame:
    """LC12: all that is not active is restored."""
    c = _cur(spark, sf)
    return CH.restored(c, c).select("id", "lifecycle_status", "merged_into_concept_id")


@query(with_("cur") + ", " + _TARGETS + """, m AS (SELECT from_id AS id, min(to_id) AS t FROM mt JOIN cur c ON c.id = mt.to_id AND c.status = 'active' WHERE from_id <> to_id GROUP BY 1)
SELECT c.id, 'merged' AS lifecycle_status, m.t AS merged_into_concept_id, 'merged into ' || m.t AS lifecycle_reason FROM cur c JOIN m ON m.id = c.id WHERE c.status = 'active'""")
def lifecycle_merge(spark: SparkSession, sf: str) -> DataFrame:
    """LC12."""
    return CH.merged_into(_cur(spark, sf), _targets(spark, sf), M.now()).select("id", "lifecycle_status", "merged_into_concept_id", "lifecycle_reason")


@query(with_("bind") + ", " + _TARGETS + """, m AS (SELECT from_id AS id, min(to_id) AS t FROM mt WHERE from_id <> to_id GROUP BY 1)
SELECT coalesce(m.t, b.concept_id) AS concept_id, b.symbol_id, round(max(b.confidence), 6) AS confidence FROM bind b LEFT JOIN m ON m.id = b.concept_id GROUP BY 1, 2""")
def lifecycle_rebind(spark: SparkSession, sf: str) -> DataFrame:
    """LC12: bindings follow the merges."""
    return rounded(CH.rebound(M.bindings(spark, sf), _targets(spark, sf)))


@query(with_("cur") + " SELECT id || '-2' AS id, name || '-part' AS name, 'active' AS lifecycle_status, 'split from ' || id AS lifecycle_reason FROM cur WHERE is_hub = 1")
def lifecycle_split(spark: SparkSession, sf: str) -> DataFrame:
    """LC12: a part is split off each hub."""
    c = _cur(spark, sf)
    parts = c.where("is_hub = 1").select(F.col("id").alias("from_id"), F.concat("id", F.lit("-2")).alias("new_id"), F.concat("name", F.lit("-part")).alias("name"))
    return CH.split_off(c, parts, M.now()).select("id", "name", "lifecycle_status", "lifecycle_reason")


@query("""WITH RECURSIVE c AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders),
h AS (SELECT arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS id FROM orders GROUP BY o_custkey),
w AS (SELECT h.id AS head, 0 AS step, h.id FROM h UNION ALL SELECT w.head, w.step + 1, c.parent FROM w JOIN c ON c.id = w.id WHERE c.parent IS NOT NULL AND w.step < 49)
SELECT CAST(head AS VARCHAR) AS head, step, CAST(id AS VARCHAR) AS id FROM w""")
def commit_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    """LC3: from the newest order of each customer back over the orders before it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    c = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lag("o_orderkey").over(w).cast("string").alias("parent_id"))
    h = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].cast("string").alias("id"))
    return CH.ancestry(c, h)


@query(with_("sym") + f""", o AS (SELECT id, source_file_id, kind AS qualified_name FROM sym WHERE removed_at IS NOT NULL AND kind IS NOT NULL), n AS (SELECT id, source_file_id, kind AS qualified_name, body_hash FROM sym WHERE removed_at IS NULL),
b AS (SELECT {ref_sql('concept_id')} AS concept_id, {ref_sql('symbol_id')} AS symbol_id, max(confidence) AS confidence, max(binding_type) AS binding_type FROM concept_symbols WHERE {ref_sql('concept_id')} IS NOT NULL AND {ref_sql('symbol_id')} IS NOT NULL GROUP BY 1, 2)
SELECT b.concept_id, n.id AS symbol_id, round(b.confidence, 6) AS confidence, o.id AS old_symbol_id FROM b JOIN o ON o.id = b.symbol_id JOIN n ON n.source_file_id = o.source_file_id AND n.qualified_name = o.qualified_name
QUALIFY row_number() OVER (PARTITION BY b.concept_id, n.id ORDER BY b.confidence DESC NULLS LAST, o.id DESC) = 1""")
def rescan_reattach(spark: SparkSession, sf: str) -> DataFrame:
    """SC11: bindings of removed symbols go to those of the same file that are there; as no name comes back in these tables, kinds stand for names."""
    s = M.symbols(spark, sf).withColumnRenamed("id", "symbol_id").withColumn("qualified_name", F.col("kind"))
    b = table(spark, sf, "concept_symbols").groupBy(ref_key("concept_id").alias("concept_id"), ref_key("symbol_id").alias("symbol_id")).agg(F.max("confidence").alias("confidence"), F.max("binding_type").alias("binding_type")).where("concept_id is not null and symbol_id is not null")
    return rounded(CH.reattached(b, s.where("removed_at is not null"), s.where("removed_at is null")).select("concept_id", "symbol_id", "confidence", "old_symbol_id"))


@query("""WITH s AS (SELECT file_path, content_hash AS digest FROM source_files), f AS (SELECT fl_source_file AS file_path, max(fl_body_hash) AS digest FROM source_chunks WHERE fl_source_file IS NOT NULL GROUP BY 1)
SELECT coalesce(s.file_path, f.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'add' WHEN f.file_path IS NULL THEN 'remove' WHEN s.digest IS NOT DISTINCT FROM f.digest THEN 'skip' ELSE 'change' END AS action FROM s FULL JOIN f ON f.file_path = s.file_path""")
def rescan_plan(spark: SparkSession, sf: str) -> DataFrame:
    """SC11, SC13: stored files against those that chunks name."""
    stored = table(spark, sf, "source_files").select("file_path", F.col("content_hash").alias("digest"))
    found = table(spark, sf, "source_chunks").where("fl_source_file is not null").groupBy(F.col("fl_source_file").alias("file_path")).agg(F.max("fl_body_hash").alias("digest"))
    return CH.rescan(stored, found)


@query("""WITH s AS (SELECT file_path, content_hash AS digest FROM source_files WHERE language = 'go'), f AS (SELECT fl_source_file AS file_path, max(fl_body_hash) AS digest FROM source_chunks WHERE fl_source_file IN (SELECT file_path FROM s) GROUP BY 1)
SELECT s.file_path, CASE WHEN f.file_path IS NULL THEN 'remove' WHEN s.digest IS NOT DISTINCT FROM f.digest THEN 'skip' ELSE 'change' END AS action FROM s LEFT JOIN f ON f.file_path = s.file_path""")
def rescan_listed(spark: SparkSession, sf: str) -> DataFrame:
    """SC12: only the listed files, those of one language."""
    stored = table(spark, sf, "source_files").select("file_path", "language", F.col("content_hash").alias("digest"))
    found = table(spark, sf, "source_chunks").where("fl_source_file is not null").groupBy(F.col("fl_source_file").alias("file_path")).agg(F.max("fl_body_hash").alias("digest"))
    return CH.rescan(stored, found, stored.where("language = 'go'"))


@query("""WITH i AS (SELECT l_suppkey AS from_id, l_partkey AS to_id, l_returnflag AS relation_type, arg_max(l_quantity / 40 - 0.2, struct_pack(a := l_orderkey * 10 + l_linenumber, q := l_quantity))::DOUBLE AS weight FROM lineitem WHERE year(l_shipdate) >= 1997 GROUP BY 1, 2, 3),
e AS (SELECT l_suppkey AS from_id, l_partkey AS to_id, l_returnflag AS relation_type, 0.5::DOUBLE AS weight, 0 AS active FROM lineitem WHERE year(l_shipdate) < 1997 GROUP BY 1, 2, 3)
SELECT from_id, to_id, relation_type, round(CASE WHEN isnan(weight) THEN 1 ELSE greatest(0, least(1, weight)) END, 6) AS weight, 1 AS active FROM i UNION ALL SELECT e.* FROM e ANTI JOIN i USING (from_id, to_id, relation_type)""")
def relations_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """SK5: later lines are upserted over earlier ones."""
    li, key = table(spark, sf, "lineitem"), [F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relation_type")]
    old = li.where(F.year("l_shipdate") < 1997).select(*key).distinct().select("*", F.lit(0.5).alias("weight"), F.lit(0).alias("active"), F.lit(0).cast("long").alias("at"))
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    new = li.where(F.year("l_shipdate") >= 1997).groupBy(*key).agg(F.max_by(F.col("l_quantity") / 40 - 0.2, F.struct(at, "l_quantity")).alias("weight"), F.max(at).alias("at"))
    return rounded(CH.relations_upserted(old, new).drop("at"))


_CACHE = "ca AS (SELECT user_id AS id, min(ts) AS created_at, CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(ts) END AS expires_at FROM events GROUP BY 1)"


@query("WITH " + _CACHE + f""", s AS (SELECT user_id AS id, arg_max(value, struct_pack(a := ts, v := value)) AS score FROM events WHERE event_type = 'click' AND value IS NOT NULL GROUP BY 1)
SELECT ca.id, round(s.score, 6) AS score, CASE WHEN s.id IS NOT NULL THEN 'agent' END AS scored_by FROM ca LEFT JOIN s ON s.id = ca.id WHERE expires_at IS NULL OR expires_at >= (SELECT max(ts) - INTERVAL 5 DAY FROM events)""")
def query_cache_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """RT19: users stand for answers, clicks for scores; put, scored and pruned."""
    e = table(spark, sf, "events")
    rows = e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last")).withColumn("expires_at", F.when(F.col("id") % 3 != 0, F.col("last"))).drop("last")
    rows = rows.withColumn("query_text", F.lit("q")).withColumn("result_json", F.lit("{}"))
    empty = rows.limit(0).withColumn("score", F.lit(None).cast("double")).withColumn("scored_by", F.lit(None).cast("string"))
    scores = e.where("event_type = 'click' and value is not null").select(F.col("user_id").alias("id"), F.col("value").alias("score"), F.lit(None).cast("string").alias("scored_by"), F.col("ts").alias("at"))
    last = e.agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("__now"))
    cache = CH.cache_scored(CH.cache_put(empty, rows), scores).join(F.broadcast(last))  # one row
    return rounded(CH.cache_pruned(cache, F.col("__now")).select("id", "score", "scored_by"))


@query()
def merge_three_way(spark: SparkSession, sf: str) -> DataFrame:
    """LC9: of doc chunks written three times or more: the first as base, the last two as the sides."""
    w = Window.partitionBy("fl_id").orderBy("fl_created_at", F.coalesce("body", F.lit("")))
    d = table(spark, sf, "source_chunks").select("fl_id", "fl_created_at", "body").distinct()
    d = d.withColumn("n", F.row_number().over(w)).withColumn("of", F.count("*").over(Window.partitionBy("fl_id")))
    pick = lambda c, name: F.max(F.when(c, F.col("body"))).alias(name)
    d = d.where("of >= 2").groupBy("fl_id").agg(pick(F.col("n") == 1, "base"), pick(F.col("n") == F.col("of") - 1, "ours"), pick(F.col("n") == F.col("of"), "theirs"))
    return T.merged(d, "fl_id")


@query()
def patch_ops(spark: SparkSession, sf: str) -> DataFrame:
    """LC10: the first block of each document is replaced and one is appended."""
    d = table(spark, sf, "documents").where("fl_type = 'doc' and text is not null").select("doc_id", F.col("text").alias("content"))
    ops = F.lit('Here: [{"op": "replace", "block_id": "block-1", "content": "New."}, {"op": "append", "content": "End."}]')
    return CH.patched(d.withColumn("ops", ops).withColumn("rewrite", F.lit("rewritten")), "doc_id")


_STOP = ", ".join(f"'{w}'" for w in GR.STOP)
_SHORT = ", ".join(f"'{w}'" for w in GR.SHORT)


def _hints_sql(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9]+'), lambda x: NOT list_contains([{_STOP}], x) AND (length(x) > 2 OR list_contains([{_SHORT}], x)) AND NOT regexp_full_match(x, '[0-9]+'))"


@query(f"""WITH ma AS (SELECT doc_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, doc_id) - 1 AS pos, source AS concept, fl_type AS origin, trim(regexp_replace(text, '[\\s\\x0B\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'), ' ') AS t FROM documents ORDER BY pos LIMIT 50),
mb AS (SELECT *, greatest(1, count(*) OVER () - pos) AS w, CASE WHEN length(t) <= 320 THEN t ELSE rtrim(substr(t, 1, 319)) || '…' END AS content FROM ma),
te AS (SELECT w * 3 AS s, unnest({_hints_sql('concept')}) AS term FROM mb UNION ALL SELECT w * 2, unnest({_hints_sql('origin')}) FROM mb UNION ALL SELECT w, unnest(list_distinct({_hints_sql('content')})) FROM mb),
sc AS (SELECT term, sum(s)::BIGINT AS score FROM te WHERE term NOT IN (SELECT unnest({_hints_sql("'" + QUESTION + "'")})) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)
SELECT term, score, row_number() OVER (ORDER BY score DESC, term) AS pos FROM sc""")
def summary_hints(spark: SparkSession, sf: str) -> DataFrame:
    """SF9: the fifty newest documents stand for matches, their sources for concepts and their types for origins; a top-25 report."""
    d = table(spark, sf, "documents").orderBy(F.col("created_at").desc_nulls_last(), "doc_id").limit(50)
    w = Window.orderBy(F.col("created_at").desc_nulls_last(), "doc_id")  # fifty rows
    m = d.select((F.row_number().over(w) - 1).alias("pos"), F.col("source").alias("concept"), F.col("fl_type").alias("origin"), F.col("text").alias("content"))
    return GR.summary_hints(m, QUESTION, 25).select("term", F.col("score").cast("long").alias("score"), F.col("pos").cast("long").alias("pos"))


@query(with_("cur", "sym", "bind") + """, ma AS (SELECT id AS concept_id, row_number() OVER (ORDER BY residual DESC NULLS LAST, id) - 1 AS pos FROM cur QUALIFY pos < 10),
j AS (SELECT f.file_path, s.line_start AS line, ma.pos, coalesce(b.confidence, 0) AS c, s.id AS symbol_id, s.name FROM ma JOIN bind b USING (concept_id) JOIN sym s ON s.id = b.symbol_id JOIN source_files f ON f.id = s.source_file_id),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY file_path, line ORDER BY pos, c DESC, symbol_id) = 1)
SELECT row_number() OVER (ORDER BY pos, c DESC, symbol_id, file_path, line) - 1 AS pos, file_path, line, name AS term, symbol_id FROM k ORDER BY 1 LIMIT 30""")
def grounding_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """RT16: the ten concepts of the greatest residual stand for matches."""
    c = M.concepts(spark, sf).orderBy(F.col("residual").desc_nulls_last(), "id").limit(10)
    m = c.select(F.col("id").alias("concept_id"), (F.row_number().over(Window.orderBy(F.col("residual").desc_nulls_last(), "id")) - 1).alias("pos"))
    f = M.files(spark, sf).select(F.col("id").alias("source_file_id"), "file_path")
    s = M.symbols(spark, sf).select(F.col("id").alias("symbol_id"), "name", "source_file_id", "line_start").join(f, "source_file_id").drop("source_file_id")
    return GR.symbol_evidence(m, M.bindings(spark, sf), s).withColumn("pos", F.col("pos").cast("long"))


@query()
def grounding_calls(spark: SparkSession, sf: str) -> DataFrame:
    """RT16: suppliers stand for symbols that call parts; near sites are one span."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee"), (F.col("l_orderkey") % 40).cast("string").alias("file"), (F.col("l_orderkey") % 900).cast("int").alias("line"))
    return GR.call_evidence(li.select(F.col("caller").alias("name")).distinct(), li)


@query("SELECT l_orderkey % 40 AS file, l_linenumber AS line, l_suppkey AS caller, l_partkey AS callee, min(l_returnflag) AS snippet FROM lineitem GROUP BY 1, 2, 3, 4")
def unique_sites(spark: SparkSession, sf: str) -> DataFrame:
    """ST2."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_returnflag").alias("snippet"))
    return CH.unique_sites(li)


_SITES = "si AS (SELECT CAST(l_suppkey AS VARCHAR) AS caller, CAST(l_partkey % 150 AS VARCHAR) AS callee, l_orderkey AS file, l_linenumber AS line, l_returnflag AS snippet FROM lineitem)"


def _call_graph_sql() -> str:
    out = "WITH " + _SITES
    for d, key, to in (("up", "callee", "caller"), ("down", "caller", "callee")):
        top = f"row_number() OVER (PARTITION BY {key} ORDER BY file, line, {to})"
        out += f""", {d}0 AS (SELECT {key} AS name, {to} AS other, file, line, snippet FROM si WHERE {key} IN ('1', '2') QUALIFY {top} <= 5), {d}f AS (SELECT DISTINCT other AS name FROM {d}0 WHERE other NOT IN ('1', '2')),
{d}1 AS (SELECT {key} AS name, {to} AS other, file, line FROM si WHERE {key} IN (SELECT name FROM {d}f) QUALIFY {top} <= 5)"""
    rows = [f"SELECT '{d}' AS direction, 0 AS depth, name, other, file, line, snippet FROM {d}0 UNION ALL SELECT '{d}', 1, name, other, file, line, NULL FROM {d}1" for d in ("up", "down")]
    return out + " " + " UNION ALL ".join(rows)


@query(_call_graph_sql())
def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """GR3: two degrees around two symbols; suppliers and parts stand for them."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("caller"), (F.col("l_partkey") % 150).cast("string").alias("callee"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("snippet"))
    return G.call_graph(li, spark.range(1, 3).select(F.col("id").cast("string").alias("name")))
