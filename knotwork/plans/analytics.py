"""Queries over retrieval, graphs, health, versions, interactions, queues and suggestions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions import scalars as S
from knotwork.operators import coverage as C
from knotwork.operators import graph as G
from knotwork.operators import health as H
from knotwork.operators import interactions as I
from knotwork.operators import keywords as K
from knotwork.operators import lifecycle as L
from knotwork.operators import queues as Q
from knotwork.operators import retrieval as R
from knotwork.operators import suggest as SG
from knotwork.operators import versioning as VS
from knotwork.operators import views as V
from knotwork.plans import mapping as M
from knotwork.plans.mapping import NOW, TERMS, with_
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


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# retrieval

_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(TERMS))
_DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
_PART = " + ".join(f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / avgdl))" for i in range(len(TERMS)))
_HIT = " OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))
_BM25 = f"""WITH tok AS (SELECT doc_id, {K.tokens_sql('text')} AS t FROM documents),
tf AS (SELECT doc_id, len(t) AS l, {_TF} FROM tok), st AS (SELECT count(*) AS n, avg(l) AS avgdl, {_DF} FROM tf),
bm AS (SELECT doc_id, -({_PART}) AS rank FROM tf, st WHERE {_HIT})"""


def _index(spark: SparkSession, sf: str) -> K.KeywordIndex:
    """The index of the documents, kept in the session."""
    return K.kept_index(spark, f"{sf}/documents", table(spark, sf, "documents"), "doc_id", "text")


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_index(spark, sf).search(TERMS))


@query(_BM25 + " SELECT doc_id, round(rank, 6) AS rank FROM bm JOIN documents USING (doc_id) ORDER BY 2, created_at DESC NULLS LAST, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """RT1, SL2: among equals the newest first."""
    d = table(spark, sf, "documents").select("doc_id", "created_at")
    return K.newest_first(_bm25(spark, sf).join(d, "doc_id"), F.col("rank"), "created_at", "doc_id", 20).select("doc_id", "rank")


_OTHER_TERMS = ["snapshot", "стать", "устаревшие", "κύκλο", "während", "requête", "概念", "حالة"]
_OTHER = _BM25[: _BM25.index("tf AS (")] + f"""q AS (SELECT unnest({K.tokens_sql("'" + ' '.join(_OTHER_TERMS) + "'")}) AS term), u AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM tok), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
hit AS (SELECT doc_id, l, term, count(*) AS tf FROM u JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
bm AS (SELECT doc_id, -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) AS rank FROM hit JOIN df USING (term), st GROUP BY 1)"""


@query(_OTHER + " SELECT doc_id, round(rank, 6) AS rank FROM bm")
def bm25_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """RT1 with words of several scripts, accents folded on both sides; all hits."""
    return _rounded(_index(spark, sf).search(K.query_tokens(" ".join(_OTHER_TERMS))))


@query(_BM25 + " SELECT doc_id, round(rank, 6) AS rank, fl_type FROM bm JOIN documents USING (doc_id) WHERE fl_type = 'journal' ORDER BY 2, 1 LIMIT 20")
def bm25_typed(spark: SparkSession, sf: str) -> DataFrame:
    types = table(spark, sf, "documents").select("doc_id", "fl_type").where("fl_type = 'journal'")
    return R.top(_bm25(spark, sf).join(types, "doc_id"), F.col("rank"), "doc_id", 20).select("doc_id", "rank", "fl_type")


_VEC = """WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
v AS (SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings, q)"""


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    return _rounded(R.vector_distances(e, "vec_id", "embedding", first))


@query(_VEC + " SELECT vec_id, distance FROM v ORDER BY distance, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(_distances(spark, sf).select("vec_id", "distance"), F.col("distance"), "vec_id", 20)


@query(_VEC + " SELECT vec_id, label, distance FROM v WHERE label IN (1, 3, 5) ORDER BY distance, vec_id LIMIT 20")
def vector_typed(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(_distances(spark, sf).where(F.col("label").isin(1, 3, 5)), F.col("distance"), "vec_id", 20)


@query(_VEC + " SELECT label, min(distance) AS distance FROM v GROUP BY 1")
def vector_rollup_min(spark: SparkSession, sf: str) -> DataFrame:
    return _distances(spark, sf).groupBy("label").agg(F.min("distance").alias("distance"))


def _lanes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    words = R.ranked(_bm25(spark, sf), F.col("rank"), "doc_id", 100).select(F.col("doc_id").alias("id"), "pos")
    vecs = R.ranked(_distances(spark, sf), F.col("distance"), "vec_id", 100).select(F.col("vec_id").alias("id"), "pos", "distance")
    return words, vecs


_LANES = _BM25.replace("WITH tok", "WITH tok") + ", " + _VEC[5:] + """, w AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(rank, 6), doc_id) - 1 AS pos FROM bm QUALIFY pos < 100),
x AS (SELECT vec_id AS id, distance, row_number() OVER (ORDER BY distance, vec_id) - 1 AS pos FROM v QUALIFY pos < 100)"""


@query(_LANES + ", u AS (SELECT id, 1.0 / (60 + pos) AS s FROM w UNION ALL SELECT id, 0.5 / (60 + pos) FROM x) SELECT id, round(sum(s), 6) AS score FROM u GROUP BY 1")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    words, vecs = _lanes(spark, sf)
    return _rounded(R.rrf({"words": (words, 1.0), "vectors": (vecs, 0.5)}, "id"))


_MERGED = _LANES + ", u AS (SELECT id, pos / (pos + 30.0)::DOUBLE AS d FROM w UNION ALL SELECT id, distance FROM x), f AS (SELECT id, min(d) AS distance, 1 - min(d) AS score FROM u GROUP BY 1)"


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    words, vecs = _lanes(spark, sf)
    return R.merge_by_distance([words.withColumn("distance", R.keyword_distance(F.col("pos"))), vecs], "id")


@query(_MERGED + " SELECT id, round(distance, 6) AS distance, round(score, 6) AS score FROM f")
def distance_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_merged(spark, sf))


_AGE = f"greatest(0.01::DOUBLE, f.score::DOUBLE * (1::DOUBLE - least(0.3::DOUBLE, 0.1::DOUBLE * least(1.0::DOUBLE, date_diff('second', d.created_at, TIMESTAMP '{NOW}') / 86400.0::DOUBLE / 47::DOUBLE) * 1.15::DOUBLE)))"


@query(_MERGED + f""", a AS (SELECT f.id, d.fl_type || ':' || lower(trim(coalesce(d.source, ''))) AS concept, round({_AGE}, 6) AS score, row_number() OVER (ORDER BY round(f.distance, 9), f.id) - 1 AS pos FROM f JOIN documents d ON d.doc_id = f.id),
b AS (SELECT *, min(pos) OVER (PARTITION BY concept) AS slot FROM a QUALIFY row_number() OVER (PARTITION BY concept ORDER BY score DESC, pos) = 1) SELECT id, concept, score, slot FROM b ORDER BY slot, id LIMIT 20""")
def hybrid_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """RT7, RT11, RT12: keyword and vector lanes fused, hydrated, aged, one row a concept, in order of the fusion."""
    merged = _merged(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("fl_type", F.lit(":"), F.lower(F.trim(F.coalesce("source", F.lit(""))))).alias("concept"), "created_at")
    j = merged.join(d, "id").withColumn("pos", F.row_number().over(Window.orderBy(F.round("distance", 9), "id")) - 1)  # at most 200 rows
    aged = j.withColumn("score", F.round(R.staleness_penalty(F.col("score"), F.timestamp_diff("SECOND", F.col("created_at"), M.now()) / 86400.0, 47, 1.15), 6))
    return R.best_per_concept(aged, "concept", "id").select("id", "concept", "score", "slot").orderBy("slot", "id").limit(20)


@query(_MERGED + """, r AS (SELECT id % 50 AS concept, max(score) AS score FROM f GROUP BY 1), m AS (SELECT p_size AS concept, max(p_retailprice / 1000) AS confidence FROM part GROUP BY 1)
SELECT coalesce(r.concept, m.concept) AS concept, round(coalesce(score, 1.0 / 61) + 0.05 * coalesce(confidence, 0), 6) AS score, score IS NULL AS injected FROM r FULL JOIN m ON r.concept = m.concept""")
def structural_boost(spark: SparkSession, sf: str) -> DataFrame:
    r = _merged(spark, sf).groupBy((F.col("id") % 50).alias("concept")).agg(F.max("score").alias("score"))
    m = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("concept"), (F.col("p_retailprice") / 1000).alias("confidence"))
    return _rounded(R.structural_boost(r, m, "concept").select("concept", "score", "injected"))


@query(_BM25 + """, e AS (SELECT lower(trim(d.source)) AS narrative, d.doc_id, round(-b.rank / 20, 6) AS score FROM bm b JOIN documents d USING (doc_id) WHERE d.fl_type = 'journal' AND d.source IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY narrative ORDER BY score DESC, doc_id) AS place FROM e WHERE score >= 0.005 QUALIFY place <= 3),
t AS (SELECT * FROM k ORDER BY score DESC, doc_id LIMIT 30) SELECT narrative, doc_id, score, place, max(score) OVER (PARTITION BY narrative) AS group_score FROM t""")
def journal_trail(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("fl_type = 'journal' and source is not null").select("doc_id", F.lower(F.trim("source")).alias("narrative"))
    e = _index(spark, sf).search(TERMS).join(d, "doc_id").select("narrative", "doc_id", F.round(-F.col("rank") / 20, 6).alias("score"))
    return R.journal_trail(e, "narrative", "doc_id")


@query("SELECT doc_id, lower(trim(source)) AS narrative, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY created_at, doc_id) AS position FROM documents WHERE source IS NOT NULL")
def narrative_positions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", F.lower(F.trim("source")).alias("narrative"), "created_at")
    return V.positions(d, "narrative", "created_at", "doc_id").drop("created_at")


@query("""WITH c AS (SELECT l_orderkey AS claim, l_partkey AS source FROM lineitem), s AS (SELECT c_custkey AS source, c_acctbal / 9973 AS freshness, ((c_custkey % 10) / 10.0)::DOUBLE AS relevance FROM customer)
SELECT claim, round(0.4 * avg(coalesce(freshness, 0.5)::DOUBLE) + 0.4 * avg(coalesce(relevance, 0.5)::DOUBLE) + 0.2 * least(1.0, count(*) / 3.0), 6) AS confidence FROM c LEFT JOIN s USING (source) GROUP BY 1""")
def claim_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """RT17: customers stand for sources; parts whose number no customer has are claims without a known source."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("source"))
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_acctbal") / 9973).alias("freshness"), ((F.col("c_custkey") % 10) / 10).alias("relevance"))
    return _rounded(R.claim_confidence(c, s, "claim", "source"))


@query("SELECT event_id, user_id, round(value, 6) AS score FROM events WHERE value IS NOT NULL ORDER BY score DESC, event_id LIMIT 20")
def query_cache_top(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value is not null").select("event_id", "user_id", F.round("value", 6).alias("score")).orderBy(F.desc("score"), "event_id").limit(20)


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 10 DAY > (SELECT max(ts) FROM events)")
def query_cache_unexpired(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).where(F.col("ts") + F.expr("INTERVAL 10 DAYS") > F.col("last")).select("event_id", "user_id")  # one row


# graphs


@query(with_("rel") + """, b AS (SELECT from_id AS node, to_id AS other, weight FROM rel WHERE active = 1 UNION ALL SELECT to_id, from_id, weight FROM rel WHERE active = 1)
SELECT node, other, count(*) AS n, max(weight) AS weight FROM b GROUP BY 1, 2""")
def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.both_ways(M.nations(spark, sf)).groupBy("node", "other").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


_SPARSE = f"WITH sp AS (SELECT id AS from_id, {ref_sql('merged_into_concept_id')} AS to_id, max(coalesce(residual, 0.5)) AS weight FROM concepts WHERE {ref_sql('merged_into_concept_id')} IS NOT NULL GROUP BY 1, 2)"


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    """The merges of all versions of concepts as relations: a graph of many small parts."""
    c = table(spark, sf, "concepts").select(F.col("id").alias("from_id"), ref_key("merged_into_concept_id").alias("to_id"), F.coalesce("residual", F.lit(0.5)).alias("w")).where("to_id is not null")
    return c.groupBy("from_id", "to_id").agg(F.max("w").alias("weight")).withColumn("active", F.lit(1))


@query(_SPARSE + """, b AS (SELECT from_id AS node, to_id AS other, weight FROM sp UNION ALL SELECT to_id, from_id, weight FROM sp), n1 AS (SELECT node, other, max(weight) AS w FROM b WHERE node <> other GROUP BY 1, 2),
f AS (SELECT a.node, c.other AS target, a.other AS via, a.w * c.w AS weight FROM n1 a JOIN n1 c ON a.other = c.node WHERE a.node <> c.other AND NOT EXISTS (SELECT 1 FROM n1 x WHERE x.node = a.node AND x.other = c.other))
SELECT node, target, via, round(weight, 6) AS weight FROM f QUALIFY row_number() OVER (PARTITION BY node, target ORDER BY weight DESC, via) = 1""")
def two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(G.two_hop(_sparse(spark, sf)))


_EDGES = with_("sites") + """, s1 AS (SELECT caller, callee, min(place) AS place FROM sites GROUP BY 1, 2),
k AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY caller ORDER BY place, callee) <= 20 OR row_number() OVER (PARTITION BY callee ORDER BY place, caller) <= 20),
e AS (SELECT source, target, max(weight) AS weight FROM (SELECT caller AS source, callee AS target, 1.0::DOUBLE AS weight FROM k UNION ALL SELECT callee, caller, 0.5 FROM k) GROUP BY 1, 2)"""


@query(_EDGES + " SELECT * FROM e")
def call_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return G.call_edges(M.call_sites(spark, sf))


@query(_EDGES + """, h1 AS (SELECT DISTINCT target AS node FROM e WHERE source = 1 AND target <> 1), h2 AS (SELECT DISTINCT e.target AS node FROM e JOIN h1 ON e.source = h1.node WHERE e.target <> 1 AND e.target NOT IN (SELECT node FROM h1))
SELECT 1 AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def call_graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return G.expand(G.call_edges(M.call_sites(spark, sf)), spark.range(1, 2).select(F.col("id").alias("node")), 2)


def _ppr_sql() -> str:
    out = _EDGES + ", o AS (SELECT source, sum(weight) AS total FROM e GROUP BY 1), sh AS (SELECT e.source, e.target, e.weight / o.total AS share FROM e JOIN o USING (source)), p0 AS (SELECT 1 AS node, 0.5::DOUBLE AS score UNION ALL SELECT 2, 0.5)"
    for i in range(10):
        out += f", p{i + 1} AS (SELECT node, sum(score) AS score FROM (SELECT sh.target AS node, 0.85 * p.score * sh.share AS score FROM p{i} p JOIN sh ON p.node = sh.source UNION ALL SELECT node, 0.15 * score FROM p0) GROUP BY 1)"
    return out + " SELECT node, round(score, 6) AS score FROM p10"


@query(_ppr_sql())
def ppr(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.range(1, 3).select(F.col("id").alias("node"))
    return _rounded(G.personalized_pagerank(spark, G.call_edges(M.call_sites(spark, sf)), seeds))


_MAT = with_("rel") + ", mat AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, max(weight) AS weight FROM rel WHERE from_id <> to_id GROUP BY 1, 2)"


@query(_MAT + " SELECT * FROM mat")
def relation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return G.relation_matrix(M.nations(spark, sf))


@query(_MAT + ", s AS (SELECT a, b, (a + b) % 10 / 10.0 AS weight FROM mat) SELECT mat.a, mat.b, round(0.8 * coalesce(s.weight, 0) + 0.2 * mat.weight, 6) AS weight FROM mat LEFT JOIN s ON s.a = mat.a AND s.b = mat.b")
def relation_blend(spark: SparkSession, sf: str) -> DataFrame:
    rel = M.nations(spark, sf)
    sim = G.relation_matrix(rel).select("a", "b", ((F.col("a") + F.col("b")) % 10 / 10).alias("weight"))
    return _rounded(G.blended(sim, rel))


@query(_MAT + " SELECT node, round(sum(greatest(0, weight)), 6) AS degree FROM (SELECT a AS node, weight FROM mat UNION ALL SELECT b, weight FROM mat) GROUP BY 1")
def laplacian_degree(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(G.degrees(G.relation_matrix(M.nations(spark, sf))))


@query()
def fiedler(spark: SparkSession, sf: str) -> DataFrame:
    return G.fiedler_value(spark, G.relation_matrix(M.nations(spark, sf)))


@query()
def spectral_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return G.spectral_clusters(spark, G.relation_matrix(M.nations(spark, sf)))


_CENT = "WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2)"


@query(_CENT + " SELECT label, list(round(m, 6) ORDER BY i) AS centroid FROM c GROUP BY 1")
def vector_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return G.centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(_CENT + ", d AS (SELECT u.label, u.vec_id, round(sum((u.x - c.m) * (u.x - c.m)), 9) AS d FROM u JOIN c ON u.label = c.label AND u.i = c.i GROUP BY 1, 2) SELECT label, vec_id AS medoid, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, vec_id) = 1")
def medoid(spark: SparkSession, sf: str) -> DataFrame:
    return G.medoids(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


@query("SELECT callee, count(*) AS calls, count(DISTINCT caller) AS callers, min(line) AS first_line FROM (SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee, l_orderkey AS file, l_linenumber AS line FROM lineitem) GROUP BY 1")
def callsite_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    return s.groupBy("callee").agg(F.count("*").alias("calls"), F.countDistinct("caller").alias("callers"), F.min("line").alias("first_line"))


# health

_CUR = "cur"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Current active concepts with a drift score: their hot bindings' number in place of body drift."""
    b = M.bindings(spark, sf).where("confidence >= 0.7").groupBy("concept_id").agg(F.count("*").alias("n"))
    d = b.select(F.col("concept_id").alias("id"), F.when(F.col("n") >= 5, 1.0).when(F.col("n") >= 3, 0.85).when(F.col("n") >= 2, 0.7).otherwise(0.5).alias("drift"))
    return M.concepts(spark, sf).where("status = 'active'").join(d, "id", "left")


_SCORED = with_("cur", "bind") + """, dr AS (SELECT concept_id AS id, CASE WHEN count(*) >= 5 THEN 1.0 WHEN count(*) >= 3 THEN 0.85 WHEN count(*) >= 2 THEN 0.7 ELSE 0.5 END AS drift FROM bind WHERE confidence >= 0.7 GROUP BY 1),
sc AS (SELECT c.*, d.drift, 0.6 * coalesce(c.ground_residual, c.churn, 0) + 0.4 * coalesce(c.lore_residual, 0) AS pb FROM cur c LEFT JOIN dr d ON d.id = c.id WHERE c.status = 'active'),
pr AS (SELECT *, greatest(pb, coalesce(staleness, 0), coalesce(drift, 0), 0.85 * coalesce(drift, 0)) AS p FROM sc)"""


@query(_SCORED + " SELECT round(sum(pb) / 1.5, 6) AS debt FROM sc")
def debt_total(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(H.total_debt(_scored(spark, sf), 0.5))


@query(_SCORED + " SELECT cluster_id, round(sum(pb) / 1.5, 6) AS debt FROM sc GROUP BY 1")
def debt_component(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(H.total_debt(_scored(spark, sf), 0.5, ["cluster_id"]))


@query(_SCORED + " SELECT round(sum(p) / 1.5, 6) AS live_debt, 10.0 AS persisted_debt, round(greatest(sum(p) / 1.5, 10.0), 6) AS debt FROM pr")
def debt_live(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(H.live_debt(_scored(spark, sf), 0.5, 10.0))


@query(_SCORED + ", t AS (SELECT p, staleness, greatest(0.001, p) AS w FROM pr ORDER BY p DESC, id LIMIT 20) SELECT round(greatest(0, least(1, sum(coalesce(staleness, 0) * w) / sum(w))), 6) AS hot_staleness FROM t")
def hot_staleness(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(H.hot_staleness(_scored(spark, sf)))


@query(_SCORED + """, t AS (SELECT avg(p) AS top FROM (SELECT p FROM pr ORDER BY p DESC, id LIMIT 5)), a AS (SELECT avg(p) AS mean, avg((p >= 0.4)::INT) AS hot FROM pr)
SELECT round(least(1, greatest(0, 0.65 * top + 0.2 * hot + 0.15 * CASE WHEN mean > 0 THEN least(1, greatest(0, (top - mean) / greatest(0.1, 1 - mean))) ELSE top END)), 6) AS priority_pressure FROM t, a""")
def priority_pressure(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(H.priority_pressure(_scored(spark, sf)))


@query("""SELECT count(*) AS open, count(*) FILTER (n <= 0) AS empty, count(*) FILTER (date_diff('second', o_orderdate, m) > 3 * 86400) AS dangling,
round(least(1, (count(*) FILTER (n <= 0) + 2 * count(*) FILTER (date_diff('second', o_orderdate, m) > 3 * 86400))::DOUBLE / greatest(4, count(*) + 2 * count(*) FILTER (date_diff('second', o_orderdate, m) > 3 * 86400))), 6) AS risk
FROM (SELECT o.*, o_orderkey % 4 AS n, (SELECT max(o_orderdate) FROM orders) AS m FROM orders o WHERE o_orderstatus IN ('O', 'P'))""")
def hygiene(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderdate")).first()[0]
    n = o.select(F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "close_failed").otherwise("closed").alias("status"), (F.col("o_orderkey") % 4).alias("entry_count"), F.col("o_orderdate").alias("opened_at"))
    return _rounded(H.hygiene(n, F.to_timestamp_ntz(F.lit(str(last)))))


_DEBT = "100 * (0.27 * staleness + 0.23 * symbol_drift + 0.18 * code_freshness + 0.08 * doc_freshness + 0.10 * coverage_gap + 0.04 * embedding_mismatch + 0.05 * hygiene + 0.05 * priority_pressure)"


@query(f"""WITH c AS (SELECT p_partkey, p_size / 50.0 AS staleness, (p_partkey % 10) / 10.0 AS symbol_drift, (p_partkey % 7) / 7.0 AS code_freshness, (p_partkey % 5) / 5.0 AS doc_freshness, (p_partkey % 3) / 3.0 AS coverage_gap, (p_partkey % 2) / 2.0 AS embedding_mismatch, (p_partkey % 4) / 4.0 AS hygiene, (p_partkey % 9) / 9.0 AS priority_pressure FROM part),
d AS (SELECT p_partkey, least(100, greatest(0, {_DEBT})) AS debt FROM c)
SELECT p_partkey, round(debt, 6) AS debt, round(100 - debt, 6) AS confidence, CASE WHEN debt <= 25 THEN 'healthy' WHEN debt <= 50 THEN 'caution' WHEN debt <= 75 THEN 'high' ELSE 'critical' END AS band,
CASE WHEN debt <= 25 THEN 1.0 WHEN debt <= 50 THEN 1.2 WHEN debt <= 75 THEN 1.4 ELSE 1.6 END::DOUBLE AS retrieval_multiplier, CASE WHEN debt <= 25 THEN 1.0 WHEN debt <= 50 THEN 1.15 WHEN debt <= 75 THEN 1.25 ELSE 1.5 END::DOUBLE AS staleness_multiplier FROM d""")
def ask_debt(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50).alias("staleness"), (k % 10 / 10).alias("symbol_drift"), (k % 7 / 7).alias("code_freshness"), (k % 5 / 5).alias("doc_freshness"), (k % 3 / 3).alias("coverage_gap"), (k % 2 / 2).alias("embedding_mismatch"), (k % 4 / 4).alias("hygiene"), (k % 9 / 9).alias("priority_pressure"))
    return _rounded(H.ask_debt(c).select("p_partkey", "debt", "confidence", "band", "retrieval_multiplier", "staleness_multiplier"))


@query(with_("cur", "sym", "bind") + """, f AS (SELECT CAST(sum(symbol_count) AS DOUBLE) AS total, (SELECT count(*) FROM bind b JOIN sym s ON s.id = b.symbol_id JOIN source_files x ON x.id = s.source_file_id) AS bound FROM source_files),
c AS (SELECT avg(coalesce(ground_residual, 0)) AS mean FROM cur WHERE status = 'active') SELECT round(least(1, (mean * bound / total + greatest(0, 1 - bound / total)) / (bound / total + greatest(0, 1 - bound / total))), 6) AS state_distance FROM c, f""")
def state_distance(spark: SparkSession, sf: str) -> DataFrame:
    f = C.file_coverage(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf))
    return _rounded(H.state_distance(M.concepts(spark, sf).where("status = 'active'"), f))


@query("SELECT id, seq, CASE WHEN residual > r0 + 0.5 THEN 'degrading' WHEN residual < r0 - 0.5 THEN 'improving' ELSE 'stable' END AS trend FROM (SELECT id, seq, residual, lag(residual) OVER (PARTITION BY id ORDER BY seq) AS r0 FROM concepts) WHERE r0 IS NOT NULL AND residual IS NOT NULL")
def debt_trend(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("seq")
    c = table(spark, sf, "concepts").select("id", "seq", "residual", F.lag("residual").over(w).alias("r0")).where("r0 is not null and residual is not null")
    return c.select("id", "seq", H.debt_trend(F.col("residual"), F.col("r0")).alias("trend"))


def _nation_concepts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("id"), F.col("n_name").alias("name"), (k % 10 / 10).alias("staleness"), F.when(k % 3 == 0, k % 4 / 4).alias("drift"), (k % 6 == 0).alias("critical"), (k % 8 / 8).alias("ground_residual"), (k % 5 / 5).alias("churn"), F.when(k % 2 == 0, k % 7 / 7).alias("lore_residual"))


_HEALTH = with_("rel") + """, c AS (SELECT n_nationkey AS id, n_name AS name, n_nationkey % 10 / 10.0 AS t, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 / 4.0 ELSE 0 END AS r, n_nationkey % 6 = 0 AS critical, 0.6 * (n_nationkey % 8 / 8.0) + 0.4 * CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 7 / 7.0 ELSE 0 END AS pb FROM nation),
b AS (SELECT *, 0.6 * t + 0.4 * r AS base FROM c), sh AS (SELECT 0.5 * avg((base >= 0.65)::INT) + 0.25 * avg((r > 0)::INT) + 0.25 * 0.4 AS shock FROM b),
e AS (SELECT from_id AS id, to_id AS other, weight AS w, 0.3 AS part FROM rel WHERE active = 1 UNION ALL SELECT to_id, from_id, weight, 0.7 FROM rel WHERE active = 1),
ar AS (SELECT e.id, sum(e.w * b.base) / sum(e.w) AS local, least(1, sum(e.w * e.part) / 3) AS infl FROM e JOIN b ON b.id = e.other GROUP BY 1),
f AS (SELECT b.*, coalesce(local, 0) AS local, coalesce(infl, 0) AS infl, shock, CASE WHEN critical THEN 1.35 ELSE 1.0 END::DOUBLE AS m FROM b LEFT JOIN ar ON ar.id = b.id, sh),
g AS (SELECT *, least(1, (0.35 * t + 0.3 * r + 0.2 * local + 0.1 * shock + 0.05 * infl) * m) AS final FROM f)"""


@query(_HEALTH + """ SELECT id, name, round(t, 6) AS time_stale, round(r, 6) AS ref_stale, round(local, 6) AS local_graph_stale, round(shock, 6) AS global_shock, round(infl, 6) AS influence, m AS multiplier, round(final, 6) AS final_stale,
round(least(1, greatest(pb, final * m * 0.75)), 6) AS residual_after, round((SELECT sum(0.6 * least(1, greatest(pb, final * 0.9))) / 1.2 FROM g), 6) AS debt_after FROM g""")
def health_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(H.health_signals(_nation_concepts(spark, sf), M.nations(spark, sf), 0.4, 0.2))


@query(_HEALTH + " SELECT id, round(greatest(0, t - (0.2 + 0.3 * final)), 6) AS staleness, round(greatest(0, pb - (0.12 + 0.25 * final)), 6) AS residual FROM g WHERE final >= 0.4")
def heal_preview(spark: SparkSession, sf: str) -> DataFrame:
    c = _nation_concepts(spark, sf)
    s = H.health_signals(c, M.nations(spark, sf), 0.4, 0.2).where("final_stale >= 0.4").join(c.select("id", H.base_pressure().alias("pb")), "id")
    a, b = H.heal(F.col("time_stale"), F.col("pb"), F.col("final_stale"))
    return _rounded(s.select("id", a.alias("staleness"), b.alias("residual")))


_CHURN = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings)
SELECT e.vec_id, CASE WHEN p.v IS NULL THEN 0 ELSE round(1 - list_cosine_similarity(e.v, p.v), 6) END AS churn, CASE WHEN p.v IS NULL THEN 'none' WHEN round(1 - list_cosine_similarity(e.v, p.v), 6) > 0.75 THEN 'structural' WHEN round(1 - list_cosine_similarity(e.v, p.v), 6) > 0.6 THEN 'strong' WHEN round(1 - list_cosine_similarity(e.v, p.v), 6) >= 0.45 THEN 'transition' ELSE 'none' END AS phase
FROM e LEFT JOIN e p ON p.vec_id = e.prev"""


@query(_CHURN)
def churn(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf, "embeddings").withColumn("prev", F.lag("vec_id").over(w))
    out = H.churn(e, "vec_id", "prev", "embedding", S.cosine_distance).select("vec_id", F.round("churn", 6).alias("churn"))
    return out.withColumn("phase", H.phase(F.col("churn")))


@query("SELECT count(*) FILTER (o_orderstatus = 'F' AND d BETWEEN 0 AND 14 * 86400) AS closed, round(count(*) FILTER (o_orderstatus = 'F' AND d BETWEEN 0 AND 14 * 86400) / 2.0, 6) AS per_week, greatest(1, ceil(25 / 10.0))::INT AS wanted FROM (SELECT o_orderstatus, date_diff('second', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS d FROM orders)")
def maintenance_rate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderdate")).first()[0]
    n = o.select(F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.col("o_orderdate").alias("closed_at"))
    return _rounded(H.maintenance_rate(n, F.to_timestamp_ntz(F.lit(str(last))), 25))


@query("SELECT id, version_id, round(residual - lag(residual) OVER (PARTITION BY id ORDER BY seq), 6) AS residual_delta FROM concepts")
def residual_history(spark: SparkSession, sf: str) -> DataFrame:
    return H.version_delta(table(spark, sf, "concepts"), "id", "seq", ["residual"]).select("id", "version_id", F.round("residual_delta", 6).alias("residual_delta"))


@query("SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, list_cosine_similarity(a.v, b.v) > 0.1 AS linked FROM (" + _CENT + " SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY 1) a JOIN (" + _CENT + " SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY 1) b ON a.label < b.label")
def cluster_edges(spark: SparkSession, sf: str) -> DataFrame:
    """GR12: similarity of the clusters' centroids; there are no more of them than labels."""
    c = G.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    j = c.select(F.col("label").alias("a"), F.col("centroid").alias("va")).join(F.broadcast(c.select(F.col("label").alias("b"), F.col("centroid").alias("vb"))), F.col("a") < F.col("b"))
    return j.select("a", "b", F.round(S.cosine("va", "vb"), 6).alias("similarity"), (S.cosine("va", "vb") > 0.1).alias("linked"))


# interactions

_FOLLOW = with_("ev") + """, j AS (SELECT a.event_id AS ask_id, f.event_id AS follow_id, f.event_type AS follow_type, epoch_us(f.tm) - epoch_us(a.tm) AS us, a.primary_action, a.stale_warning, f.tm FROM ev a JOIN ev f ON a.result_id = f.result_id
  WHERE a.event_type = 'ask' AND f.event_type IN ('recall', 'show', 'trail', 'open_narrative') AND f.tm >= a.tm AND f.tm <= a.tm + INTERVAL 600 SECOND),
fu AS (SELECT ask_id, follow_id, follow_type, us / 1e6 AS seconds, primary_action, stale_warning FROM j QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY tm, follow_id) = 1),
re AS (SELECT DISTINCT a.event_id AS ask_id FROM ev a JOIN ev f ON a.result_id = f.result_id WHERE a.event_type = 'ask' AND f.event_type IN ('recall', 'trail') AND f.tm >= a.tm AND f.tm <= a.tm + INTERVAL 1800 SECOND),
lo AS (SELECT o.event_id FROM ev o WHERE o.event_type = 'open_narrative' AND EXISTS (SELECT 1 FROM ev c WHERE c.event_type = 'close_narrative' AND c.subject = o.subject AND c.tm >= o.tm))"""


@query(_FOLLOW + " SELECT ask_id, follow_id, follow_type, seconds FROM fu")
def followups_10m(spark: SparkSession, sf: str) -> DataFrame:
    return I.follow_ups(M.interactions(spark, sf)).select("ask_id", "follow_id", "follow_type", "seconds")


@query(_FOLLOW + " SELECT ask_id FROM re")
def reuse_30m(spark: SparkSession, sf: str) -> DataFrame:
    return I.reused(M.interactions(spark, sf))


@query(_FOLLOW + " SELECT event_id FROM lo")
def open_close_loop(spark: SparkSession, sf: str) -> DataFrame:
    return I.closed_loops(M.interactions(spark, sf))


@query(_FOLLOW + """, n AS (SELECT count(*) FILTER (event_type = 'ask') AS asks, count(*) FILTER (event_type = 'open_narrative') AS opened, count(*) FILTER (event_type = 'close_narrative') AS closed, count(*) FILTER (event_type = 'ask' AND stale_warning) AS stale_asks, avg(value) AS trust, count(value) AS scored FROM ev)
SELECT asks, opened, closed, scored, round((SELECT count(*) FROM fu) / asks::DOUBLE, 6) AS actionability, (SELECT median(seconds) FROM fu) AS median_seconds, round((SELECT count(*) FROM re) / asks::DOUBLE, 6) AS reuse,
round((SELECT count(*) FILTER (follow_type = primary_action) / nullif(count(*), 0)::DOUBLE FROM fu), 6) AS clarity, round((SELECT count(*) FILTER (stale_warning) FROM fu) / nullif(stale_asks, 0)::DOUBLE, 6) AS stale_follow_through, round(trust, 6) AS trust, round((SELECT count(*) FROM lo) / nullif(opened, 0)::DOUBLE, 6) AS loop_completion FROM n""")
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    e = M.interactions(spark, sf)
    return _rounded(I.scorecard(e, e.select(F.col("value").alias("score"))))


# versions


@query(with_("com") + " SELECT id, line, row_number() OVER (PARTITION BY line ORDER BY committed_at DESC, id DESC) - 1 AS step FROM com QUALIFY step < 50")
def commit_walk(spark: SparkSession, sf: str) -> DataFrame:
    return VS.walk(M.commits(spark, sf), "line", "committed_at", "id").select("id", "line", "step")


_LOG = with_("com", "tree") + """, p AS (SELECT id, line, lag(id) OVER (PARTITION BY line ORDER BY committed_at, id) AS parent_id FROM com), q AS (SELECT * FROM p WHERE parent_id IS NOT NULL),
n AS (SELECT q.id, t.concept_id, t.chunk_id FROM q JOIN tree t ON t.commit_id = q.id), o AS (SELECT q.id, t.concept_id, t.chunk_id FROM q JOIN tree t ON t.commit_id = q.parent_id),
d AS (SELECT coalesce(n.id, o.id) AS line, coalesce(n.concept_id, o.concept_id) AS concept_id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change, o.chunk_id AS chunk_id_old, n.chunk_id AS chunk_id_new FROM n FULL JOIN o ON n.id = o.id AND n.concept_id = o.concept_id WHERE n.chunk_id IS DISTINCT FROM o.chunk_id)"""


def _tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = VS.with_parent(M.commits(spark, sf), "line", "committed_at", "id").where("parent_id is not null").select(F.col("id").alias("commit"), "parent_id")
    t = M.trees(spark, sf)
    new = t.join(c.select(F.col("commit").alias("commit_id")), "commit_id").select(F.col("commit_id").alias("line"), "concept_id", "chunk_id")
    old = t.join(c.withColumnRenamed("parent_id", "commit_id"), "commit_id").select(F.col("commit").alias("line"), "concept_id", "chunk_id")
    return VS.tree_diff(old, new)


@query(_LOG + " SELECT * FROM d")
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_diff(spark, sf)


@query(_LOG + " SELECT line, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified FROM d GROUP BY 1")
def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_diff(spark, sf).groupBy("line").agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "modified")])


@query("SELECT id, version_id, row_number() OVER w AS version, lag(version_id) OVER w AS previous_version_id, lead(version_id) OVER w AS next_version_id FROM concepts WINDOW w AS (PARTITION BY id ORDER BY seq)")
def version_history(spark: SparkSession, sf: str) -> DataFrame:
    return VS.version_chain(table(spark, sf, "concepts").select("id", "seq", "version_id"), "id", "seq").drop("seq")


@query(with_("com") + """ (SELECT 'main' AS ref, id FROM com ORDER BY committed_at DESC, id DESC LIMIT 1) UNION ALL (SELECT 'main~2', id FROM com ORDER BY committed_at DESC, id DESC LIMIT 1 OFFSET 2)
UNION ALL (SELECT 'main@1997-06-30', id FROM com WHERE committed_at < DATE '1997-07-01' ORDER BY committed_at DESC, id DESC LIMIT 1)""")
def ref_resolve(spark: SparkSession, sf: str) -> DataFrame:
    c = M.commits(spark, sf)
    out = [VS.resolve_ref(c, r, M.now()).select(F.lit(r).alias("ref"), "id") for r in ("main", "main~2", "main@1997-06-30", "bogus")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(with_("com", "tree") + " SELECT t.concept_id, t.chunk_id, c.id AS first_commit FROM tree t JOIN com c ON c.id = t.commit_id QUALIFY row_number() OVER (PARTITION BY t.concept_id, t.chunk_id ORDER BY c.committed_at, c.id) = 1")
def commit_for_chunk(spark: SparkSession, sf: str) -> DataFrame:
    c = M.commits(spark, sf).withColumnRenamed("id", "commit_id")
    return M.trees(spark, sf).join(c, "commit_id").groupBy("concept_id", "chunk_id").agg(F.min_by("commit_id", F.struct("committed_at", "commit_id")).alias("first_commit"))


@query("""WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'archive' WHEN 'purchase' THEN 'restore' WHEN 'signup' THEN 'merge' ELSE 'patch' END AS kind FROM events)
SELECT user_id, arg_max(CASE kind WHEN 'archive' THEN 'archived' WHEN 'merge' THEN 'merged' ELSE 'active' END, event_id) AS status FROM k WHERE kind <> 'patch' GROUP BY 1""")
def lifecycle_fold(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "archive").when(F.col("event_type") == "purchase", "restore").when(F.col("event_type") == "signup", "merge").otherwise("patch")
    return VS.fold_lifecycle(table(spark, sf, "events").withColumn("kind", kind), "user_id", "event_id", "kind")


# queues

_OPEN = with_("jobs") + ", ok AS (SELECT *, CASE status WHEN 'queued' THEN 0 ELSE 1 END AS state_rank FROM jobs WHERE (status = 'queued' OR (status = 'leased' AND lease_expires_at <= TIMESTAMP '2001-01-01')) AND attempt < 2)"


def _lease_now() -> F.Column:
    return F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00"))


@query(_OPEN + " SELECT scope, id, 'leased' AS status, 'w1' AS owner, attempt + 1 AS attempt, TIMESTAMP '2001-01-01 00:00:30' AS lease_expires_at, TIMESTAMP '2001-01-01' AS updated_at FROM ok QUALIFY row_number() OVER (PARTITION BY scope ORDER BY state_rank, attempt, updated_at, id) = 1")
def lease_claim(spark: SparkSession, sf: str) -> DataFrame:
    return Q.claim(M.jobs(spark, sf), _lease_now(), "w1", ["scope"], 1)


@query(_OPEN + " SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY state_rank, attempt, updated_at, id) AS place FROM ok")
def lease_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("scope").orderBy("state_rank", "attempt", "updated_at", "id")
    return Q.claimable(M.jobs(spark, sf), _lease_now(), 1).withColumn("place", F.row_number().over(w)).select("scope", "id", "place")


@query(with_("jobs") + " SELECT scope, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'leased') AS leased, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, min(CASE WHEN status IN ('queued', 'leased') THEN updated_at END) AS oldest_pending FROM jobs GROUP BY 1")
def lease_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.counts(M.jobs(spark, sf), ["scope"])


@query(with_("jobs") + " SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN attempt < 2 THEN 'queued' ELSE 'failed' END ELSE 'done' END AS status FROM jobs WHERE status = 'leased'")
def lease_settle(spark: SparkSession, sf: str) -> DataFrame:
    j = M.jobs(spark, sf).where("status = 'leased'")
    return Q.settle(j, F.when(F.col("id") % 5 == 0, "failed").otherwise("done"), 1).select("id", "status")


# suggestions

_PAIRS = f"""WITH st AS (SELECT fl_id AS id, fl_cluster AS cluster FROM state_chunks WHERE fl_cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fl_id ORDER BY fl_created_at DESC NULLS LAST, fl_cluster DESC) = 1),
m AS (SELECT DISTINCT {code_sql('model')} AS model, dim FROM embed_models),
v AS (SELECT {ref_sql('e.chunk_id')} AS id, m.model, e.embedding::DOUBLE[] AS v FROM chunk_embeddings e JOIN m ON {code_sql('e.model')} = m.model WHERE len(e.embedding) = m.dim AND len(list_filter(e.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY {ref_sql('e.chunk_id')}, m.model ORDER BY e.embedded_at DESC NULLS LAST, e.id DESC) = 1),
r AS (SELECT st.id, st.cluster, v.model, v.v FROM st JOIN v ON v.id = st.id), p AS (SELECT a.id AS a, b.id AS b, a.cluster, max(list_cosine_similarity(a.v, b.v)) AS s FROM r a JOIN r b ON a.cluster = b.cluster AND a.model = b.model AND a.id < b.id GROUP BY 1, 2, 3)"""


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    """id, cluster, model, v: a clustered state chunk once for every model of embed_models of which it has a usable vector, the latest."""
    st = table(spark, sf, "state_chunks").where("fl_cluster is not null").groupBy(F.col("fl_id").alias("id")).agg(F.max(F.struct("fl_created_at", F.col("fl_cluster").alias("cluster")))["cluster"].alias("cluster"))
    m = F.broadcast(table(spark, sf, "embed_models").select(code_key("model").alias("model"), "dim").dropDuplicates(["model"]))  # a fixed table of few rows
    e = table(spark, sf, "chunk_embeddings").select(ref_key("chunk_id").alias("chunk"), code_key("model").alias("model"), "embedding", "embedded_at", "id").join(m, "model").where(F.size("embedding") == F.col("dim"))
    e = e.where(F.forall("embedding", lambda x: F.abs(x) < float("inf")) & F.exists("embedding", lambda x: x != 0))
    w = Window.partitionBy("chunk", "model").orderBy(F.col("embedded_at").desc_nulls_last(), F.col("id").desc())
    v = e.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("chunk").alias("id"), "model", F.col("embedding").alias("v"))
    return st.join(v, "id")


@query(_PAIRS + " SELECT a, b, cluster, round(s, 6) AS similarity, CASE WHEN s > 0.92 THEN 'merge' ELSE 'relate' END AS kind FROM p WHERE s >= 0.70")
def suggest_merge_relate(spark: SparkSession, sf: str) -> DataFrame:
    """SG1: vectors are compared within model and cluster; a pair that is similar under several models comes once, with the greatest cosine."""
    r = _clustered(spark, sf)
    kind = r.schema["cluster"].dataType
    pairs = SG.similar_pairs(r.withColumn("group", F.concat_ws(":", "cluster", "model")), "id", "group", "v")
    pairs = pairs.groupBy("a", "b", F.substring_index("cluster", ":", 1).cast(kind).alias("cluster")).agg(F.max("similarity").alias("similarity"))
    return _rounded(SG.merge_or_relate(pairs))


@query(with_("cur") + " SELECT id, 'review' AS kind, residual AS confidence FROM cur WHERE residual > 0.65 AND status = 'active'")
def suggest_review(spark: SparkSession, sf: str) -> DataFrame:
    return SG.review(M.concepts(spark, sf).where("status = 'active'"))


@query(with_("cur") + " SELECT id, 'cluster-drift' AS kind, lore_residual AS confidence FROM cur WHERE lore_residual > 0.55 AND ground_residual < 0.35")
def suggest_cluster_drift(spark: SparkSession, sf: str) -> DataFrame:
    return SG.cluster_drift(M.concepts(spark, sf))


@query(with_("cur", "bind") + " SELECT id, 'archive' AS kind, staleness AS confidence FROM cur WHERE staleness > 0.7 AND status = 'active' AND id NOT IN (SELECT concept_id FROM bind WHERE confidence >= 0.8)")
def suggest_archive(spark: SparkSession, sf: str) -> DataFrame:
    return SG.archive(M.concepts(spark, sf).where("status = 'active'"), M.bindings(spark, sf).where("confidence >= 0.8").select(F.col("concept_id").alias("id")))


_UNC = with_("sym", "bind") + ", un AS (SELECT s.id AS symbol_id, s.name, s.kind, f.file_path, string_split(f.file_path, '/') AS s FROM sym s JOIN source_files f ON f.id = s.source_file_id WHERE s.export_status IN ('exported', 'default_export') AND s.id NOT IN (SELECT symbol_id FROM bind)), dn AS (SELECT *, CASE WHEN len(s) <= 2 THEN s[1] ELSE s[1] || '/' || s[2] END AS directory, CASE WHEN kind IN ('interface', 'type', 'enum') THEN 3.0 WHEN kind IN ('class', 'struct', 'trait') THEN 1.5 WHEN kind IN ('method', 'impl') THEN 0.5 ELSE 1.0 END AS weight FROM un)"


def _unc(spark: SparkSession, sf: str) -> DataFrame:
    return C.uncovered(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf), True)


@query(_UNC + " SELECT directory, count(*) AS n, round((10 - least(len(string_split(directory, '/')), 9)) * 100 + 10 * count(*) + sum(weight), 6)::DOUBLE AS score FROM dn GROUP BY 1 HAVING count(*) >= 2 ORDER BY score DESC, directory LIMIT 8")
def suggest_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(SG.coverage_gaps(_unc(spark, sf)))


_IMPORTS = "im AS (SELECT DISTINCT a.file_path AS from_path, b.file_path AS to_path FROM symbols s JOIN symbols p ON upper(trim(s.parent_id, ' ' || chr(9) || chr(10) || chr(13))) = p.id JOIN source_files a ON a.id = s.source_file_id JOIN source_files b ON b.id = p.source_file_id WHERE a.file_path <> b.file_path), dd AS (SELECT CASE WHEN len(string_split(from_path, '/')) <= 2 THEN string_split(from_path, '/')[1] ELSE array_to_string(string_split(from_path, '/')[1:2], '/') END AS source, CASE WHEN len(string_split(to_path, '/')) <= 2 THEN string_split(to_path, '/')[1] ELSE array_to_string(string_split(to_path, '/')[1:2], '/') END AS directory FROM im), dep AS (SELECT directory, count(DISTINCT source) AS n_dependents FROM dd WHERE source <> directory GROUP BY 1)"


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    """Where a symbol's parent lies in another file, that file counts as imported."""
    s = table(spark, sf, "symbols").select("id", ref_key("parent_id").alias("p"), "source_file_id").distinct()
    f = table(spark, sf, "source_files").select("id", "file_path")
    child = s.where("p is not null").select("p", F.col("source_file_id").alias("fa"))
    parent = s.select(F.col("id").alias("p"), F.col("source_file_id").alias("fb"))
    j = child.join(parent, "p").select("fa", "fb").distinct().where("fa <> fb")
    return j.join(f.select(F.col("id").alias("fa"), F.col("file_path").alias("from_path")), "fa").join(f.select(F.col("id").alias("fb"), F.col("file_path").alias("to_path")), "fb").select("from_path", "to_path")


@query("WITH " + _IMPORTS + " SELECT * FROM dep")
def dependency_boost(spark: SparkSession, sf: str) -> DataFrame:
    return SG.dependency_boost(_imports(spark, sf))


@query(_UNC + ", " + _IMPORTS + """, pl AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY weight DESC, name, symbol_id) AS place FROM dn), g AS (SELECT directory, count(*) AS n, count(*) FILTER (place <= 8) AS shown, sum(weight) AS kinds FROM pl GROUP BY 1),
h AS (SELECT g.directory, n, shown, ((10 - least(len(string_split(g.directory, '/')), 9)) * 100 + 10 * n + kinds + 200 * coalesce(n_dependents, 0))::DOUBLE AS score FROM g LEFT JOIN dep ON dep.directory = g.directory) SELECT row_number() OVER (ORDER BY score DESC, directory) AS phase, directory, n, shown, score FROM h""")
def bootstrap_plan(spark: SparkSession, sf: str) -> DataFrame:
    return SG.bootstrap_plan(_unc(spark, sf), SG.dependency_boost(_imports(spark, sf)))


@query(_SCORED + """, cv AS (SELECT id, staleness, ground_residual, (hash_free % 10) / 10.0 AS coverage FROM (SELECT id, staleness, ground_residual, length(name) AS hash_free FROM sc)),
k AS (SELECT id, 'review' AS kind, residual AS confidence, 0 AS priority FROM cur WHERE residual > 0.65 AND status = 'active'
UNION ALL SELECT id, 'knowledge-pull', 0.5 * (1 - coverage) + 0.3 * coalesce(staleness, 0) + 0.2 * coalesce(ground_residual, 0), 1 FROM cv WHERE 0.5 * (1 - coverage) + 0.3 * coalesce(staleness, 0) + 0.2 * coalesce(ground_residual, 0) > 0.3
UNION ALL SELECT id, 'cluster-drift', lore_residual, 2 FROM cur WHERE lore_residual > 0.55 AND ground_residual < 0.35)
SELECT id, kind, round(confidence, 6) AS confidence, priority FROM k ORDER BY priority, round(confidence, 6) DESC, id LIMIT 50""")
def suggestions_all(spark: SparkSession, sf: str) -> DataFrame:
    cov = _scored(spark, sf).withColumn("coverage", F.length("name") % 10 / 10)
    kinds = [SG.review(M.concepts(spark, sf).where("status = 'active'")), SG.knowledge_pull(cov), SG.cluster_drift(M.concepts(spark, sf))]
    return SG.put_together([_rounded(k) for k in kinds], ["review", "knowledge-pull", "cluster-drift"], 50)


# more of retrieval, graphs and lifecycle

_SYMBOL_TERMS = ["merge", "narrative", "cache"]
_STF = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(_SYMBOL_TERMS))
_SDF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))
_SPART = " + ".join(f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / avgdl))" for i in range(3))


def _symbol_index(spark: SparkSession, sf: str) -> K.KeywordIndex:
    s = M.symbols(spark, sf).select("id", "kind", F.regexp_replace(F.concat_ws(" ", "name", "qualified_name", "signature"), "([A-Z])", " $1").alias("text"))
    return K.kept_index(spark, f"{sf}/symbols", s, "id", "text", ("kind",))


_SYMBOL_SEARCH = with_("sym") + f""", tok AS (SELECT id, {K.tokens_sql("regexp_replace(concat_ws(' ', name, qualified_name, signature), '([A-Z])', ' " + chr(92) + "1', 'g')")} AS t, kind FROM sym),
tf AS (SELECT id, kind, len(t) AS l, {_STF} FROM tok), st AS (SELECT count(*) AS n, avg(l) AS avgdl, {_SDF} FROM tf),
found AS (SELECT id, kind, round(-({_SPART}), 6) AS rank FROM tf, st WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0)"""


@query(_SYMBOL_SEARCH + " SELECT id, rank FROM found WHERE kind = 'function' ORDER BY 2, 1 LIMIT 20")
def symbol_search_kind(spark: SparkSession, sf: str) -> DataFrame:
    """RT4 with a kind: the corpus' figures are still those of all symbols."""
    return R.top(_rounded(_symbol_index(spark, sf).search(_SYMBOL_TERMS, "kind")).where("kind = 'function'"), F.col("rank"), "id", 20).select("id", "rank")


@query(_SYMBOL_SEARCH + " SELECT id, rank FROM found ORDER BY 2, 1 LIMIT 20")
def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    """RT4: keyword search over names and signatures, whose parts are words of their own."""
    return R.top(_rounded(_symbol_index(spark, sf).search(_SYMBOL_TERMS)), F.col("rank"), "id", 20)


_SIGNALS = "sg AS (SELECT c_nationkey % 12 AS concept, sum(o_totalprice) / 1e6 AS ppr, 0.5 + (c_nationkey % 3) / 6.0 AS confidence, c_nationkey = 3 AS seed FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"


@query("WITH " + _SIGNALS + """, rs AS (SELECT r_regionkey AS concept, 0.1 * r_regionkey AS score FROM region), bt AS (SELECT * FROM sg WHERE NOT seed ORDER BY ppr DESC, concept LIMIT 40),
s AS (SELECT concept, max(ppr / (SELECT max(ppr) FROM bt) * confidence) AS signal FROM bt GROUP BY 1)
SELECT rs.concept, round(score + 0.2 * coalesce(signal, 0), 6)::DOUBLE AS score, false AS injected FROM rs LEFT JOIN s ON s.concept = rs.concept
UNION ALL (SELECT concept, round(0.2 * signal, 6)::DOUBLE, true FROM s WHERE concept NOT IN (SELECT concept FROM rs) ORDER BY signal DESC, concept LIMIT 5)""")
def ppr_fusion(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_nationkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    g = o.groupBy("c_nationkey").agg((F.sum("o_totalprice") / 1e6).alias("ppr")).select((k % 12).alias("concept"), "ppr", (0.5 + k % 3 / 6).alias("confidence"), (k == 3).alias("seed"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("concept"), (0.1 * F.col("r_regionkey")).alias("score"))
    return _rounded(R.ppr_fusion(r, g, "concept"))


@query(with_("sym", "bind") + """, su AS (SELECT b.concept_id, b.symbol_id, s.name AS symbol, f.file_path, b.confidence, row_number() OVER (PARTITION BY b.concept_id ORDER BY b.confidence DESC, b.symbol_id) AS rn FROM bind b JOIN sym s ON s.id = b.symbol_id JOIN source_files f ON f.id = s.source_file_id),
d AS (SELECT concept_id, count(*) AS n FROM su WHERE confidence < 0.6 GROUP BY 1)
SELECT c.id AS concept_id, list_sort(list_distinct(x.files)) AS files, x.symbols, coalesce(d.n, 0) AS n_drifted FROM (SELECT DISTINCT id FROM concepts) c LEFT JOIN (SELECT concept_id, list(file_path) AS files, list(symbol ORDER BY rn) FILTER (rn <= 5) AS symbols FROM su GROUP BY 1) x ON x.concept_id = c.id LEFT JOIN d ON d.concept_id = c.id""")
def result_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Weak bindings stand for drifted ones."""
    b = C.summaries(M.bindings(spark, sf), M.symbols(spark, sf), M.files(spark, sf))
    r = table(spark, sf, "concepts").select(F.col("id").alias("concept_id")).distinct()
    return R.enriched(r, b, b.where("confidence < 0.6").select("concept_id"), "concept_id").select("concept_id", "files", "symbols", "n_drifted")


@query(_MAT + """, l AS (SELECT n_nationkey AS node, n_regionkey AS cluster FROM nation), sm AS (SELECT m.a, m.b, m.weight FROM mat m JOIN l x ON x.node = m.a JOIN l y ON y.node = m.b WHERE x.cluster = y.cluster),
g AS (SELECT node, avg(weight) AS mean FROM (SELECT a AS node, weight FROM sm UNION ALL SELECT b, weight FROM sm) GROUP BY 1) SELECT l.node, l.cluster, round(coalesce(1 - g.mean, 0), 4) AS lore_residual FROM l LEFT JOIN g ON g.node = l.node""")
def lore_residual(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("cluster"))
    return G.lore_residuals(G.relation_matrix(M.nations(spark, sf)), labels).withColumn("lore_residual", F.round("lore_residual", 4))


@query(_MAT + """, l AS (SELECT n_nationkey AS node, n_regionkey AS cluster FROM nation), k AS (SELECT DISTINCT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b FROM mat m JOIN l x ON x.node = m.a JOIN l y ON y.node = m.b WHERE m.weight > 0.95)
SELECT x.r_regionkey AS a, y.r_regionkey AS b FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = x.r_regionkey AND k.b = y.r_regionkey)""")
def status_cluster_gaps(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("cluster"))
    return G.disconnected_clusters(G.relation_matrix(M.nations(spark, sf)).where("weight > 0.95"), labels)


@query(f"""WITH c AS (SELECT {code_sql('fl_embedding_model')} AS want, {ref_sql('fl_id')} AS id FROM state_chunks WHERE fl_embedding_model IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fl_id ORDER BY fl_created_at DESC NULLS LAST, fl_embedding_model DESC) = 1),
e AS (SELECT DISTINCT {ref_sql('chunk_id')} AS id, {code_sql('model')} AS model FROM chunk_embeddings)
SELECT c.want AS model, count(*) AS chunks, count(*) FILTER (e.id IS NULL) AS missing FROM c LEFT JOIN e ON e.id = c.id AND e.model = c.want GROUP BY 1""")
def embedding_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "state_chunks").where("fl_embedding_model is not null").groupBy("fl_id").agg(F.max(F.struct("fl_created_at", "fl_embedding_model"))["fl_embedding_model"].alias("fl_embedding_model")).select(ref_key("fl_id").alias("id"), code_key("fl_embedding_model").alias("model"))
    e = table(spark, sf, "chunk_embeddings").select(ref_key("chunk_id").alias("id"), code_key("model").alias("model"), F.lit(True).alias("there")).distinct()
    return c.join(e, ["id", "model"], "left").groupBy("model").agg(F.count("*").alias("chunks"), F.count_if(F.col("there").isNull()).alias("missing"))


@query(with_("cur") + """, q AS (SELECT DISTINCT fl_narrative_origin AS request_id, fl_concept AS target FROM state_chunks WHERE fl_narrative_origin IS NOT NULL AND fl_concept IS NOT NULL), k AS (SELECT lower(name) AS key, bool_or(status = 'active') AS live FROM cur GROUP BY 1)
SELECT request_id, target, CASE WHEN live IS NULL THEN 'missing' WHEN live THEN 'ok' ELSE 'inactive' END AS verdict FROM q LEFT JOIN k ON k.key = lower(q.target)""")
def open_targets(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "state_chunks").where("fl_narrative_origin is not null and fl_concept is not null").groupBy(F.col("fl_narrative_origin").alias("request_id")).agg(F.collect_set("fl_concept").alias("targets"))
    return L.check_targets(r, M.concepts(spark, sf).select("name", "status"))


@query(with_("com", "tree") + """, e AS (SELECT l_partkey AS concept_id, l_orderkey * 10 + l_linenumber AS entry_id, l_linenumber AS position FROM lineitem), u AS (SELECT concept_id, max(chunk_id) AS chunk_id, min(chunk_id) AS base_chunk_id FROM tree GROUP BY 1)
SELECT x.concept_id, x.n AS n_entries, x.f AS first_entry, u.chunk_id, CASE WHEN u.chunk_id IS NULL THEN 'create' WHEN u.base_chunk_id <> u.chunk_id THEN 'merge' ELSE 'update' END AS action FROM (SELECT concept_id, count(*) AS n, arg_min(entry_id, position::BIGINT * 1000000000000 + entry_id) AS f FROM e GROUP BY 1) x LEFT JOIN u ON u.concept_id = x.concept_id""")
def close_plan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("concept_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.col("l_linenumber").alias("position"))
    u = M.trees(spark, sf).groupBy("concept_id").agg(F.max("chunk_id").alias("chunk_id"), F.min("chunk_id").alias("base_chunk_id"))
    return L.close_plan(e, u)


@query(with_("chunks") + """, s AS (SELECT supersedes_id AS k, id AS by_id FROM chunks WHERE supersedes_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY supersedes_id ORDER BY fl_created_at, id) = 1) SELECT c.id, s.by_id AS superseded_by FROM chunks c LEFT JOIN s ON s.k = c.id""")
def superseded_by(spark: SparkSession, sf: str) -> DataFrame:
    return L.superseded_by(M.chunks(spark, sf), "id", "supersedes_id", "fl_created_at").select("id", "superseded_by")
