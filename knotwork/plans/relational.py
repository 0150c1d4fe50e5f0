"""Queries over views, joins, aggregates, windows and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions import scalars as S
from knotwork.operators.keywords import tokens, tokens_sql
from knotwork.operators import coverage as C
from knotwork.operators import views as V
from knotwork.plans import mapping as M
from knotwork.plans.mapping import NOW, with_
from knotwork.tables import code_key, code_sql, ref_key, ref_sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# views and filters


@query("SELECT id, version_id, name, residual, staleness FROM concepts QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return V.latest(table(spark, sf, "concepts"), "id", "seq").select("id", "version_id", "name", "residual", "staleness")


@query("SELECT id, version_id, round(residual - lead(residual) OVER w, 6) AS residual_delta, round(staleness - lead(staleness) OVER w, 6) AS staleness_delta FROM concepts WINDOW w AS (PARTITION BY id ORDER BY seq DESC) QUALIFY row_number() OVER w = 1")
def previous_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = V.with_previous(table(spark, sf, "concepts"), "id", "seq", ["residual", "staleness"])
    return d.select("id", "version_id", F.round(F.col("residual") - F.col("previous_residual"), 6).alias("residual_delta"), F.round(F.col("staleness") - F.col("previous_staleness"), 6).alias("staleness_delta"))


@query("SELECT seq, version_id, id FROM concepts ORDER BY seq DESC LIMIT 1")
def latest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "concepts").select("seq", "version_id", "id").orderBy(F.desc("seq")).limit(1)


@query(with_("cur") + " SELECT id, name FROM cur WHERE status = 'active'")
def active_filter(spark: SparkSession, sf: str) -> DataFrame:
    return M.concepts(spark, sf).where(V.is_active("status")).select("id", "name")


@query(with_("cur") + " SELECT lower(name) AS name, count(*) AS n, arg_max(id, seq) AS newest FROM cur GROUP BY 1 HAVING count(*) > 1")
def name_taken(spark: SparkSession, sf: str) -> DataFrame:
    return M.concepts(spark, sf).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.max_by("id", "seq").alias("newest")).where("n > 1")


@query(with_("chunks") + " SELECT id, concept_id FROM chunks WHERE id NOT IN (SELECT supersedes_id FROM chunks WHERE supersedes_id IS NOT NULL)")
def not_superseded(spark: SparkSession, sf: str) -> DataFrame:
    return V.not_superseded(M.chunks(spark, sf), "id", "supersedes_id").select("id", "concept_id")


@query(with_("cur", "chunks") + " SELECT c.id, c.concept_id, cur.name FROM chunks c LEFT JOIN cur ON cur.id = c.concept_id WHERE c.id NOT IN (SELECT supersedes_id FROM chunks WHERE supersedes_id IS NOT NULL) AND (cur.id IS NULL OR cur.status = 'active')")
def guarded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = M.concepts(spark, sf).select(F.col("id").alias("concept_id"), "name", F.col("status").alias("concept_status"))
    j = V.not_superseded(M.chunks(spark, sf), "id", "supersedes_id").join(c, "concept_id", "left")
    return j.where(V.is_active("concept_status")).select("id", "concept_id", "name")


@query("SELECT id, name FROM symbols WHERE name = (SELECT min(name) FROM symbols) GROUP BY ALL")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "symbols")
    least = s.agg(F.min("name").alias("name"))
    return s.select("id", "name").join(F.broadcast(least), "name").distinct().select("id", "name")  # one row


@query(f"SELECT DISTINCT s.id, s.name FROM symbols s WHERE s.id IN (SELECT {ref_sql('symbol_id')} FROM concept_symbols WHERE confidence >= 0.9)")
def batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "concept_symbols").where("confidence >= 0.9").select(ref_key("symbol_id").alias("id"))
    return table(spark, sf, "symbols").join(wanted, "id", "left_semi").select("id", "name").distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 3 DAY")
def dangling_narratives(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    return o.where(F.col("o_orderstatus").isin("O", "P")).join(F.broadcast(last)).where(F.col("o_orderdate") < F.col("last") - F.expr("INTERVAL 3 DAYS")).select("o_orderkey", "o_custkey")  # one row


@query(with_("rel") + " SELECT from_id, to_id, weight FROM rel WHERE active = 1 AND (from_id = 3 OR to_id = 3)")
def relation_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    return M.nations(spark, sf).where((F.col("active") == 1) & ((F.col("from_id") == 3) | (F.col("to_id") == 3))).select("from_id", "to_id", "weight")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS critical, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS state_rank FROM orders")
def case_projection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("critical"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("state_rank"))


# bindings and coverage

#: No binding of the test tables has drifted; that of a weak one is taken for another body's.
_DRIFT = with_("cur", "sym", "bind") + ", wk AS (SELECT * REPLACE (CASE WHEN confidence < 0.6 THEN reverse(bound_body_hash) ELSE bound_body_hash END AS bound_body_hash) FROM bind), drift AS (SELECT b.concept_id, c.name AS concept, b.symbol_id, s.name AS symbol, f.file_path, b.confidence FROM wk b JOIN sym s ON s.id = b.symbol_id JOIN source_files f ON f.id = s.source_file_id LEFT JOIN cur c ON c.id = b.concept_id WHERE b.bound_body_hash IS NOT NULL AND s.body_hash IS NOT NULL AND b.bound_body_hash <> s.body_hash)"


def _drifted(spark: SparkSession, sf: str) -> DataFrame:
    weak = F.when(F.col("confidence") < 0.6, F.reverse("bound_body_hash")).otherwise(F.col("bound_body_hash"))
    return C.drifted(M.bindings(spark, sf).withColumn("bound_body_hash", weak), M.symbols(spark, sf), M.files(spark, sf), M.concepts(spark, sf))


@query(_DRIFT + " SELECT * FROM drift")
def drifted_bindings(spark: SparkSession, sf: str) -> DataFrame:
    return _drifted(spark, sf)


@query(_DRIFT + " SELECT concept_id, count(*) AS n_drifted, CASE WHEN count(*) >= 5 THEN 1.0 WHEN count(*) >= 3 THEN 0.85 WHEN count(*) >= 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM drift GROUP BY 1")
def drift_score(spark: SparkSession, sf: str) -> DataFrame:
    return C.drift_scores(_drifted(spark, sf))


@query(with_("sym", "bind") + " SELECT b.concept_id, b.symbol_id, s.name AS symbol, s.kind, f.file_path, b.binding_type, b.confidence FROM bind b JOIN sym s ON s.id = b.symbol_id JOIN source_files f ON f.id = s.source_file_id")
def binding_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.summaries(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf))


_UNCOVERED = " SELECT s.id AS symbol_id, s.name, s.kind, s.export_status, f.file_path FROM sym s JOIN source_files f ON f.id = s.source_file_id WHERE s.id NOT IN (SELECT symbol_id FROM bind)"


@query(with_("sym", "bind") + _UNCOVERED)
def uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return C.uncovered(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf))


@query(with_("sym", "bind") + _UNCOVERED + " AND s.export_status IN ('exported', 'default_export')")
def uncovered_exported(spark: SparkSession, sf: str) -> DataFrame:
    return C.uncovered(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf), True)


@query(with_("cur", "sym", "bind") + " SELECT id FROM bind WHERE symbol_id IN (SELECT id FROM sym) AND concept_id IN (SELECT id FROM cur)")
def kept_bindings(spark: SparkSession, sf: str) -> DataFrame:
    return C.kept_bindings(M.bindings(spark, sf), M.symbols(spark, sf), M.concepts(spark, sf)).select("id")


@query(with_("cur", "sym", "bind") + """, bd AS (SELECT concept_id, count(*) AS bound FROM bind GROUP BY 1),
r AS (SELECT x.concept_id, count(*) AS reachable FROM (SELECT DISTINCT b.concept_id, s.source_file_id FROM bind b JOIN sym s ON s.id = b.symbol_id) x JOIN sym t ON t.source_file_id = x.source_file_id GROUP BY 1)
SELECT c.id AS concept_id, c.name, coalesce(bound, 0) AS bound, coalesce(reachable, 0) AS reachable,
  round(CASE WHEN coalesce(bound, 0) = 0 THEN 1.0 WHEN coalesce(reachable, 0) = 0 THEN 0.0 ELSE greatest(0, 1 - bound::DOUBLE / reachable) END, 6) AS capacity
FROM cur c LEFT JOIN bd ON bd.concept_id = c.id LEFT JOIN r ON r.concept_id = c.id""")
def concept_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return C.concept_coverage(M.bindings(spark, sf), M.symbols(spark, sf), M.concepts(spark, sf)).withColumn("capacity", F.round("capacity", 6))


@query(with_("sym", "bind") + """ SELECT f.file_path, f.language, f.symbol_count, coalesce(x.n, 0) AS bound_count, round(CASE WHEN f.symbol_count > 0 THEN coalesce(x.n, 0)::DOUBLE / f.symbol_count ELSE 0 END, 6) AS ratio
FROM source_files f LEFT JOIN (SELECT s.source_file_id, count(*) AS n FROM bind b JOIN sym s ON s.id = b.symbol_id GROUP BY 1) x ON x.source_file_id = f.id""")
def file_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return C.file_coverage(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query(with_("sym", "bind") + """ SELECT count(*) FILTER (export_status IN ('exported', 'default_export')) AS total_exported,
count(*) FILTER (export_status IN ('exported', 'default_export') AND id IN (SELECT symbol_id FROM bind)) AS bound_exported,
count(DISTINCT CASE WHEN id IN (SELECT symbol_id FROM bind) THEN source_file_id END) AS files_with_bindings, (SELECT count(*) FROM source_files) AS total_files FROM sym""")
def coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.coverage_stats(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf))


@query(with_("bind") + """ SELECT count(*) AS total, count(*) FILTER (binding_type = 'manual') AS manual, count(*) FILTER (binding_type = 'mention') AS mention, count(*) FILTER (binding_type = 'file-overlap') AS file_overlap,
count(*) FILTER (binding_type = 'semantic') AS semantic, count(DISTINCT concept_id) AS concepts, count(DISTINCT symbol_id) AS symbols, round(avg(confidence), 6) AS mean_confidence FROM bind""")
def binding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.binding_counts(M.bindings(spark, sf))


@query(with_("sym") + " SELECT kind, count(*) AS n FROM sym GROUP BY 1")
def kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.symbols(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM source_files GROUP BY 1")
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").groupBy("language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(f"SELECT {code_sql('model')} AS model, count(*) AS n FROM chunk_embeddings GROUP BY 1")
def model_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_embeddings").groupBy(code_key("model").alias("model")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(with_("bind", "sym") + " SELECT b.concept_id, s.source_file_id, list_sort(list(DISTINCT s.kind)) AS kinds FROM bind b JOIN sym s ON s.id = b.symbol_id WHERE s.kind IS NOT NULL GROUP BY 1, 2")
def kinds_union(spark: SparkSession, sf: str) -> DataFrame:
    s = M.symbols(spark, sf).where("kind is not null").select(F.col("id").alias("symbol_id"), "source_file_id", "kind")
    return M.bindings(spark, sf).join(s, "symbol_id").groupBy("concept_id", "source_file_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


@query("SELECT DISTINCT fl_doc_path FROM doc_chunks")
def distinct_doc_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_chunks").select("fl_doc_path").distinct()


@query(with_("chunks") + " SELECT concept_id, id AS chunk_id, fl_narrative_origin AS narrative FROM chunks WHERE concept_id IS NOT NULL AND fl_narrative_origin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY fl_created_at DESC, id DESC) = 1")
def last_narrative(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("concept_id").orderBy(F.desc("fl_created_at"), F.desc("id"))
    c = M.chunks(spark, sf).where("concept_id is not null and fl_narrative_origin is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return c.select("concept_id", F.col("id").alias("chunk_id"), F.col("fl_narrative_origin").alias("narrative"))


@query(with_("bind", "cur") + " SELECT c.name, count(*) AS n, round(max(b.confidence), 6) AS best FROM bind b JOIN cur c ON c.id = b.concept_id WHERE b.symbol_id IN (SELECT id FROM symbols WHERE kind = 'class') GROUP BY 1")
def symbol_concepts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "symbols").where("kind = 'class'").select(F.col("id").alias("symbol_id"))
    c = M.concepts(spark, sf).select(F.col("id").alias("concept_id"), "name")
    return M.bindings(spark, sf).join(wanted, "symbol_id", "left_semi").join(c, "concept_id").groupBy("name").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("best"))


@query("""WITH s AS (SELECT DISTINCT fl_id, fl_source_file, body FROM source_chunks WHERE body IS NOT NULL), found AS (SELECT fl_source_file AS key, max(sha256(body)) AS digest FROM s GROUP BY 1),
stored AS (SELECT file_path AS key, content_hash AS digest FROM source_files)
SELECT coalesce(stored.key, found.key) AS key, CASE WHEN stored.key IS NULL THEN 'add' WHEN found.key IS NULL THEN 'remove' WHEN stored.digest IS NOT DISTINCT FROM found.digest THEN 'skip' ELSE 'change' END AS action
FROM stored FULL JOIN found ON stored.key = found.key""")
def ingest_hash_diff(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "source_chunks").where("body is not null").groupBy(F.col("fl_source_file").alias("key")).agg(F.max(S.body_hash("body")).alias("digest"))
    stored = table(spark, sf, "source_files").select(F.col("file_path").alias("key"), F.col("content_hash").alias("digest"))
    return V.hash_diff(stored, found, "key", "digest")


@query(f"""WITH e AS (SELECT {ref_sql('chunk_id')} AS chunk_id, {code_sql('model')} AS model, id, embedded_at FROM chunk_embeddings)
SELECT chunk_id, model, id FROM e WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id, model ORDER BY embedded_at DESC NULLS LAST, id DESC) = 1""")
def embedding_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "chunk_embeddings").select(ref_key("chunk_id").alias("chunk_id"), code_key("model").alias("model"), "id", "embedded_at").where("chunk_id is not null")
    w = Window.partitionBy("chunk_id", "model").orderBy(F.col("embedded_at").desc_nulls_last(), F.col("id").desc())
    return e.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("chunk_id", "model", "id")


@query("SELECT p_partkey, count(*) AS n, round(max(weight), 6) AS weight FROM (SELECT p_partkey, p_size / 50.0 AS weight FROM part UNION ALL SELECT l_partkey, least(1.0, greatest(0.0, l_quantity / 40)) FROM lineitem) GROUP BY 1")
def relation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("weight"))
    b = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), S.clamp(F.col("l_quantity") / 40).alias("weight"))
    return a.unionByName(b).groupBy("p_partkey").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("SELECT DISTINCT lower(trim(p_brand)) AS tag FROM part WHERE trim(p_brand) <> ''")
def tag_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(S.normalize_tag("p_brand").alias("tag")).where("tag <> ''").distinct()


# scalar functions over whole tables


@query()
def camel_expand(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "symbols").where("qualified_name is not null").select(F.col("qualified_name").alias("name")).distinct().withColumn("expanded", S.expand_camel("name"))


@query("SELECT DISTINCT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, lower(trim(name)) AS tag FROM concepts WHERE name IS NOT NULL")
def slug_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "concepts").where("name is not null").select("name", S.slug("name").alias("slug"), S.normalize_tag("name").alias("tag")).distinct()


@query("""WITH p AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS s FROM source_files)
SELECT file_path, CASE WHEN len(s) <= 2 THEN s[1] ELSE s[1] || '/' || s[2] END AS directory, len(s) AS depth FROM p""")
def dir_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").select("file_path", S.directory("file_path").alias("directory"), S.depth("file_path").alias("depth")).distinct()


@query("""SELECT id, CASE WHEN kind IN ('interface', 'type', 'enum') THEN 3.0 WHEN kind IN ('class', 'struct', 'trait') THEN 1.5 WHEN kind = 'function' THEN 1.0 WHEN kind IN ('method', 'impl') THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM (SELECT DISTINCT id, kind FROM symbols)""")
def kind_weights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "symbols").select("id", "kind").distinct().select("id", S.kind_weight("kind").alias("weight"))


@query("""SELECT name, list_distinct_sorted AS variants FROM (SELECT DISTINCT qualified_name AS name, list_sort(list_distinct([qualified_name, regexp_extract(qualified_name, '([^:.#]*)$', 1)])) AS list_distinct_sorted FROM symbols WHERE qualified_name IS NOT NULL)""")
def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "symbols").where("qualified_name is not null").select(F.col("qualified_name").alias("name"), F.array_sort(S.name_variants("qualified_name")).alias("variants")).distinct()


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.token_estimate("text").alias("tokens"), S.body_hash("text").alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(dead[ -]end|failed|abandoned|doesn''t work|gave up)\b') THEN 'dead-end' WHEN regexp_matches(text, '\?\s*$') THEN 'question' WHEN regexp_matches(text, '(?i)\b(confirmed|verified|validated)\b') THEN 'confirmed' ELSE 'finding' END AS status FROM documents WHERE fl_type = 'journal' AND text IS NOT NULL""")
def status_inference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("fl_type = 'journal' and text is not null").select("doc_id", S.journal_status("text").alias("status"))


@query(r"""WITH d AS (SELECT doc_id, lower(text) AS t, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_matches(t, '\b(call graph|call chain|callchain|multi[- ]hop|upstream|downstream|end[- ]to[- ]end|e2e)\b') OR regexp_matches(t, '\b(path|chain|through|across|between|bridge|flow)\b') OR regexp_matches(t, '\b(how|why)\b(?s:.){0,80}\b(from|to|reach|lead|propagate)\b') AS deep,
contains(t, 'exact') OR contains(t, 'file path') OR contains(t, 'filepath') OR contains(t, 'function') OR contains(t, 'method') OR contains(t, 'where defined') OR contains(t, 'line') OR contains(t, 'symbol') OR contains(t, 'entrypoint')
 OR regexp_matches(text, '\b[\w./-]+\.(ts|tsx|js|jsx|mjs|cjs|json|md|toml|yaml|yml|sql)\b') OR regexp_matches(text, '`([^`]{2,120})`') AS exact FROM d""")
def query_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.is_deep_query("text").alias("deep"), S.wants_exact("text").alias("exact"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substring(t, 1, 119)) || '…' END AS snippet FROM d""")
def snippet_compact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.compact("text", 120).alias("snippet"))


@query()
def brief_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.excerpts("text", F.lit(M.QUESTION)).alias("excerpts")).where(F.size("excerpts") > 0)


@query("""WITH s AS (SELECT fl_id, arg_max(body, fl_created_at) AS body FROM source_chunks GROUP BY 1), l AS (SELECT fl_id, string_split(body, chr(10)) AS a FROM s WHERE body IS NOT NULL)
SELECT fl_id, array_to_string(a[2:4], chr(10)) AS body FROM l WHERE len(a) >= 2""")
def symbol_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "source_chunks").where("body is not null and fl_created_at is not null").groupBy("fl_id").agg(F.max_by("body", "fl_created_at").alias("body"))
    return s.select("fl_id", S.lines_between("body", F.lit(2), F.lit(4)).alias("body")).where("body is not null")


@query(r"""WITH t AS (SELECT narrative, unnest(list_distinct(list_filter(""" + tokens_sql("text") + r""", lambda x: length(x) > 6))) AS term FROM (SELECT code AS narrative, text FROM (SELECT lower(trim(source)) AS code, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)))
SELECT term, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, term LIMIT 25""")
def summary_terms(spark: SparkSession, sf: str) -> DataFrame:
    """SF9: the most frequent long words, one a text, a top-25 report."""
    d = table(spark, sf, "documents").where("source is not null and text is not null").select(F.explode(F.array_distinct(F.filter(tokens("text"), lambda x: F.length(x) > 6))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(25)
