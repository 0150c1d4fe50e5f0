"""Queries of the search over all kinds of chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import hybrid as HY
from knotwork.operators import keywords as K
from knotwork.plans import mapping as M
from knotwork.plans.mapping import QUESTION, with_
from knotwork.plans.registry import registry
from knotwork.tables import code_key, code_sql, ref_key, ref_sql, table

QUERIES, ORACLES, query = registry()
TERMS = K.query_tokens(QUESTION + " retry path")
TEXT_MODEL, CODE_MODEL, DIM = "lorevec-text-64", "lorevec-code-64", 64


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks, each id once, the latest row: what hydrated() needs. State chunks have their concept as content."""
    none = lambda t: F.lit(None).cast(t)
    s = table(spark, sf, "source_chunks").select(ref_key("fl_id").alias("id"), F.lit("source").alias("fl_type"), F.col("fl_symbol").alias("title"), none("string").alias("concept_id"), F.col("body").alias("content"), F.col("fl_source_file").alias("path"), F.col("fl_line_start").alias("line_start"), F.col("fl_line_end").alias("line_end"), code_key("fl_language").alias("language"), none("double").alias("residual"), none("double").alias("staleness"), F.col("fl_created_at").alias("created_at"))
    d = table(spark, sf, "doc_chunks").select(ref_key("fl_id").alias("id"), F.lit("doc").alias("fl_type"), F.col("fl_doc_path").alias("title"), none("string").alias("concept_id"), "content", F.col("fl_doc_path").alias("path"), none("int").alias("line_start"), none("int").alias("line_end"), none("string").alias("language"), none("double").alias("residual"), none("double").alias("staleness"), F.col("fl_created_at").alias("created_at"))
    t = table(spark, sf, "state_chunks").select(ref_key("fl_id").alias("id"), F.lit("chunk").alias("fl_type"), F.col("fl_concept").alias("title"), ref_key("fl_concept_id").alias("concept_id"), F.col("fl_concept").alias("content"), none("string").alias("path"), none("int").alias("line_start"), none("int").alias("line_end"), none("string").alias("language"), F.col("fl_residual").alias("residual"), F.col("fl_staleness").alias("staleness"), F.col("fl_created_at").alias("created_at"))
    rows = s.unionByName(d).unionByName(t).where("id is not null")
    rest = [c for c in rows.columns if c not in ("id", "created_at")]
    return rows.groupBy("id").agg(F.max(F.struct("created_at", *rest)).alias("r")).select("id", "r.*")


_ALL = f"""ch AS (SELECT * FROM (
  SELECT {ref_sql('fl_id')} AS id, 'source' AS fl_type, fl_symbol AS title, NULL::VARCHAR AS concept_id, body AS content, fl_source_file AS path, fl_line_start AS line_start, fl_line_end AS line_end, {code_sql('fl_language')} AS language, NULL::DOUBLE AS residual, NULL::DOUBLE AS staleness, fl_created_at AS created_at FROM source_chunks
  UNION ALL SELECT {ref_sql('fl_id')}, 'doc', fl_doc_path, NULL, content, fl_doc_path, NULL, NULL, NULL, NULL, NULL, fl_created_at FROM doc_chunks
  UNION ALL SELECT {ref_sql('fl_id')}, 'chunk', fl_concept, {ref_sql('fl_concept_id')}, fl_concept, NULL, NULL, NULL, NULL, fl_residual, fl_staleness, fl_created_at FROM state_chunks)
  WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, fl_type DESC NULLS LAST, title DESC NULLS LAST, concept_id DESC NULLS LAST, content DESC NULLS LAST, path DESC NULLS LAST, line_start DESC NULLS LAST, line_end DESC NULLS LAST, language DESC NULLS LAST, residual DESC NULLS LAST, staleness DESC NULLS LAST) = 1)"""


def _vectors(spark: SparkSession, sf: str, model: str) -> DataFrame:
    """id, fl_type, created_at, vec: the latest usable vector of each chunk in a model."""
    e = table(spark, sf, "chunk_embeddings").where(code_key("model") == model).where(F.size("embedding") == DIM)
    e = e.where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    e = e.groupBy(ref_key("chunk_id").alias("id")).agg(F.max(F.struct("embedded_at", F.col("id").alias("row_id"), F.col("embedding").alias("vec"))).alias("r")).select("id", "r.vec")
    return e.join(chunks(spark, sf).select("id", "fl_type", "created_at"), "id")


def _vectors_sql(name: str, model: str) -> str:
    return f"""{name} AS (SELECT e.id, c.fl_type, c.created_at, e.v FROM (SELECT {ref_sql('chunk_id')} AS id, embedding::DOUBLE[] AS v FROM chunk_embeddings WHERE {code_sql('model')} = '{model}' AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY {ref_sql('chunk_id')} ORDER BY embedded_at DESC NULLS LAST, chunk_embeddings.id DESC NULLS LAST) = 1) e JOIN ch c ON c.id = e.id)"""


def _cosine_sql(a: str, b: str) -> str:
    return f"round(1 - coalesce(CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) = 0 THEN 0 ELSE list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b})) END, 0), 6)"


def _vector_lane_sql(name: str, vectors: str, query: str, kind: str) -> str:
    ties = "" if kind == "chunk" else "created_at DESC NULLS LAST, "
    return f"{name} AS (SELECT id, distance, row_number() OVER (ORDER BY distance, {ties}id) - 1 AS pos FROM (SELECT id, created_at, {_cosine_sql('v', 'q')} AS distance FROM {vectors}, {query} WHERE fl_type = '{kind}') QUALIFY pos < 20)"


def _keyword_lane_sql(name: str, kind: str) -> str:
    return f"{name} AS (SELECT id, pos / (pos + 30.0)::DOUBLE AS distance, pos FROM (SELECT id, row_number() OVER (ORDER BY round(rank, 6), created_at DESC NULLS LAST, id) - 1 AS pos FROM bm WHERE fl_type = '{kind}') WHERE pos < 20)"


_TERM_LIST = ", ".join(f"'{t}'" for t in TERMS)
_LANES = f"""{_ALL}, {_vectors_sql('tv', TEXT_MODEL)}, {_vectors_sql('cv', CODE_MODEL)}, tq AS (SELECT v AS q FROM tv WHERE fl_type = 'chunk' ORDER BY id LIMIT 1), cq AS (SELECT v AS q FROM cv ORDER BY id LIMIT 1),
tok AS (SELECT id, fl_type, created_at, {K.tokens_sql('content')} AS t FROM ch), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
hit AS (SELECT id, fl_type, created_at, l, term, count(*) AS tf FROM (SELECT id, fl_type, created_at, len(t) AS l, unnest(t) AS term FROM tok) WHERE term IN ({_TERM_LIST}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
bm AS (SELECT id, fl_type, created_at, -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) AS rank FROM hit JOIN df USING (term), st GROUP BY 1, 2, 3),
{_vector_lane_sql('l1', 'tv', 'tq', 'chunk')}, {_vector_lane_sql('l2', 'cv', 'cq', 'source')}, {_keyword_lane_sql('l3', 'source')}, {_keyword_lane_sql('l4', 'chunk')}, {_vector_lane_sql('l5', 'tv', 'tq', 'doc')}, {_keyword_lane_sql('l6', 'doc')},
al AS (SELECT id, distance, 'text_vector' AS lane FROM l1 UNION ALL SELECT id, distance, 'code_vector' FROM l2 UNION ALL SELECT id, distance, 'bm25_source' FROM l3 UNION ALL SELECT id, distance, 'bm25_chunk' FROM l4 UNION ALL SELECT id, distance, 'doc_vector' FROM l5 UNION ALL SELECT id, distance, 'bm25_doc' FROM l6),
fu AS (SELECT *, row_number() OVER (ORDER BY distance, id) - 1 AS pos FROM (SELECT id, distance, lane FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, lane) = 1))"""


def _lanes(spark: SparkSession, sf: str, mode: str | None = None, kind: str = "chunk") -> dict[str, DataFrame]:
    """The lanes of the question; the vectors of the first chunks stand for the question's own."""
    text, code = _vectors(spark, sf, TEXT_MODEL), _vectors(spark, sf, CODE_MODEL)
    index = K.kept_index(spark, f"{sf}/chunks", chunks(spark, sf).select("id", "fl_type", "created_at", "content"), "id", "content", ("fl_type", "created_at"))
    return HY.lanes(index, TERMS, text, text.where("fl_type = 'chunk'").agg(F.min_by("vec", "id").alias("q")), code, code.agg(F.min_by("vec", "id").alias("q")), mode, kind)


@query("WITH " + _LANES + " SELECT pos, id, lane, round(distance, 6) AS distance, round(1 - distance, 6) AS score FROM fu")
def six_lane_search(spark: SparkSession, sf: str) -> DataFrame:
    """RT7."""
    f = HY.fused(_lanes(spark, sf))
    return f.select("pos", "id", "lane", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("WITH " + _LANES + " SELECT pos, id, round(distance, 6) AS distance FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id) - 1 AS pos FROM (SELECT id, min(distance) AS distance FROM al WHERE lane <> 'code_vector' GROUP BY 1))")
def arch_search(spark: SparkSession, sf: str) -> DataFrame:
    """RT7 in the mode that has no code lane."""
    return HY.fused(_lanes(spark, sf, "arch")).select("pos", "id", F.round("distance", 6).alias("distance"))


@query("WITH " + _LANES + " SELECT lane, count(*) AS candidates FROM al GROUP BY 1 UNION ALL SELECT 'fused', count(*) FROM fu")
def lane_counts(spark: SparkSession, sf: str) -> DataFrame:
    return HY.lane_counts(_lanes(spark, sf))


_SYMBOL_BODIES = f"""sx AS (SELECT * FROM sym), bb AS (SELECT {ref_sql('fl_symbol')} AS k, arg_max(body, struct_pack(t := fl_created_at, b := body)) AS body FROM source_chunks WHERE fl_symbol IS NOT NULL AND body IS NOT NULL GROUP BY 1),
rb AS (SELECT b.concept_id, s.qualified_name, f.file_path, s.line_start, s.line_end, f.language, bb.body, row_number() OVER (PARTITION BY b.concept_id ORDER BY b.confidence DESC NULLS LAST, b.symbol_id) AS rn
  FROM bind b JOIN sx s ON s.id = b.symbol_id JOIN source_files f ON f.id = s.source_file_id LEFT JOIN bb ON bb.k = upper(s.name) WHERE b.concept_id IN (SELECT concept_id FROM ch JOIN fu USING (id) WHERE concept_id IS NOT NULL)),
bd AS (SELECT concept_id, string_agg(chr(10) || chr(10) || '[Symbol: ' || coalesce(qualified_name, 'null') || ' (' || coalesce(file_path, 'null') || ':' || coalesce(line_start::VARCHAR, 'null') || '-' || coalesce(line_end::VARCHAR, 'null') || ')]' || chr(10) || '```' || coalesce(language, 'null') || chr(10) || body || chr(10) || '```', '' ORDER BY rn) AS bodies FROM rb WHERE rn <= 5 AND body IS NOT NULL AND body <> '' GROUP BY 1)"""
_HYDRATED = f"""hy AS (SELECT f.pos, c.id, c.fl_type, round(1 - f.distance, 6) AS score, c.title AS concept, c.staleness,
  CASE c.fl_type WHEN 'source' THEN '[Source: ' || coalesce(path, '') || ':' || coalesce(line_start::VARCHAR, '') || '-' || coalesce(line_end::VARCHAR, '') || ']' || chr(10) || '```' || coalesce(language, '') || chr(10) || coalesce(content, '') || chr(10) || '```'
    WHEN 'doc' THEN '[Doc: ' || coalesce(path, '') || ']' || chr(10) || substr(coalesce(content, ''), 1, 4000) ELSE coalesce(content, '') || coalesce(bd.bodies, '') END AS content,
  CASE WHEN c.fl_type = 'chunk' THEN CASE WHEN staleness > 0.5 THEN 'content may be stale' WHEN residual > 0.5 THEN 'high residual — verify against code' END END AS warning
  FROM fu f JOIN ch c USING (id) LEFT JOIN bd ON bd.concept_id = c.concept_id WHERE f.pos < 10)"""


def _hydrated(spark: SparkSession, sf: str) -> DataFrame:
    results = HY.fused(_lanes(spark, sf), 10).withColumn("score", F.round("score", 6))
    all_ = chunks(spark, sf)
    mine = all_.join(results.select("id"), "id", "left_semi")
    newest = table(spark, sf, "source_chunks").where("fl_symbol is not null and body is not null").groupBy(ref_key("fl_symbol").alias("k")).agg(F.max_by("body", F.struct("fl_created_at", "body")).alias("body"))
    symbols = M.symbols(spark, sf).select(F.col("id").alias("symbol_id"), "source_file_id", "name", "qualified_name", "line_start", "line_end")
    symbols = symbols.join(newest, F.upper("name") == F.col("k"), "left")
    files = M.files(spark, sf).select(F.col("id").alias("source_file_id"), "file_path", "language")
    bodies = HY.symbol_bodies(mine.where("concept_id is not null"), M.bindings(spark, sf).select("concept_id", "symbol_id", "confidence"), symbols, files)
    return HY.hydrated(results.select("pos", "id", "score"), all_, bodies)


@query(with_("sym", "bind") + ", " + _LANES + ", " + _SYMBOL_BODIES + ", " + _HYDRATED + " SELECT pos, id, fl_type, score, concept, content, warning FROM hy")
def hydrated_results(spark: SparkSession, sf: str) -> DataFrame:
    """RT8: the first ten results with their content, the bodies of their symbols, and warnings."""
    return _hydrated(spark, sf).drop("staleness")


@query(with_("sym", "bind") + ", " + _LANES + ", " + _SYMBOL_BODIES + ", " + _HYDRATED + """, tr AS (SELECT DISTINCT lower(trim(source)) AS narrative FROM documents WHERE fl_type = 'journal' AND source IS NOT NULL),
one AS (SELECT arg_min(concept, pos) AS concept, count(*) AS n, coalesce(bool_or(warning IS NOT NULL OR coalesce(staleness, 0) > 0.4), false) AS stale FROM hy), nt AS (SELECT count(*) AS n_trails, min(narrative) AS narrative FROM tr)
SELECT 1 AS place, CASE WHEN n > 0 THEN 'show' ELSE 'ingest' END AS kind, true AS is_primary, CASE WHEN n > 0 THEN concept END AS target, CASE WHEN n = 0 THEN 'No concept matched cleanly. Refresh the lake before trusting an empty answer.'
  WHEN stale THEN 'Inspect the canonical concept before acting because this answer carries drift or staleness signals.' ELSE 'Inspect the canonical concept before making a change.' END AS reason FROM one
UNION ALL SELECT 2, 'recall', false, NULL, 'Expand the sources, file refs, and bindings behind this answer.'
UNION ALL SELECT 3, 'trail', false, narrative, 'Replay the strongest investigation trail behind this answer.' FROM nt WHERE n_trails = 1""")
def next_actions(spark: SparkSession, sf: str) -> DataFrame:
    """RT20."""
    r = _hydrated(spark, sf)
    trails = table(spark, sf, "documents").where("fl_type = 'journal' and source is not null").select(F.lower(F.trim("source")).alias("narrative")).distinct()
    return HY.next_actions(r, HY.stale_signals(r), trails)
