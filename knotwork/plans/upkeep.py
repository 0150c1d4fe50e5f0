"""Queries of the upkeep of a graph of concepts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import changes as CH
from knotwork.operators import health as H
from knotwork.operators import suggest as SG
from knotwork.operators import upkeep as U
from knotwork.plans import mapping as M
from knotwork.plans import search as S
from knotwork.plans.mapping import NOW, with_
from knotwork.plans.registry import registry
from knotwork.tables import code_key, code_sql, micros, ref_key, ref_sql, table

QUERIES, ORACLES, query = registry()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""WITH e AS (SELECT label, ((vec_id % 4) * (label % 2))::DOUBLE AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS i, round(CASE WHEN sum(w) = 0 THEN avg(x) ELSE sum(w * x) / sum(w) END, 6) AS x FROM e GROUP BY 1, 2""")
def weighted_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """AG12: labels of even number have no weight at all and get the plain mean."""
    e = table(spark, sf, "embeddings").withColumn("w", (F.col("vec_id") % 4) * (F.col("label") % 2))
    return U.weighted_centroids(e, "label", "embedding", "w").select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def _symbol_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """symbol_id, vec: the code vector of the source chunk that is about a symbol of that name, the greatest chunk id of several."""
    v = S._vectors(spark, sf, S.CODE_MODEL).select("id", "vec").join(S.chunks(spark, sf).select("id", F.upper("title").alias("k")), "id").where("k is not null")
    v = v.groupBy("k").agg(F.max_by("vec", "id").alias("vec"))
    return M.symbols(spark, sf).select(F.col("id").alias("symbol_id"), F.upper("name").alias("k")).join(v, "k").select("symbol_id", "vec")


_BASE = f"""{S._ALL}, {S._vectors_sql('tv', S.TEXT_MODEL)}, {S._vectors_sql('cv', S.CODE_MODEL)},
sv AS (SELECT s.id AS symbol_id, x.v FROM sym s JOIN (SELECT upper(c.title) AS k, arg_max(cv.v, cv.id) AS v FROM cv JOIN ch c ON c.id = cv.id WHERE c.title IS NOT NULL GROUP BY 1) x ON x.k = upper(s.name))"""


def _concept_vectors(spark: SparkSession, sf: str) -> DataFrame:
    c = M.concepts(spark, sf).select("id", ref_key("active_chunk_id").alias("chunk_id"))
    return c.join(S._vectors(spark, sf, S.TEXT_MODEL).select(F.col("id").alias("chunk_id"), "vec"), "chunk_id").select("id", "vec")


@query(with_("cur", "sym", "bind") + ", " + _BASE + f""", e AS (SELECT b.concept_id AS id, coalesce(b.confidence, 0) AS w, unnest(sv.v) AS x, generate_subscripts(sv.v, 1) AS i FROM bind b JOIN sv ON sv.symbol_id = b.symbol_id),
g AS (SELECT id, i, CASE WHEN sum(w) = 0 THEN avg(x) ELSE sum(w * x) / sum(w) END AS x FROM e GROUP BY 1, 2), gm AS (SELECT id, list(x ORDER BY i) AS m FROM g GROUP BY 1),
d AS (SELECT c.id, {S._cosine_sql('tv.v', 'gm.m')} AS distance FROM cur c JOIN tv ON tv.id = {ref_sql('c.active_chunk_id')} JOIN gm ON gm.id = c.id)
SELECT c.id, round(coalesce(d.distance, c.churn), 6) AS ground_residual, CASE WHEN d.distance IS NULL THEN 'churn' ELSE 'text' END AS basis FROM cur c LEFT JOIN d ON d.id = c.id""")
def ground_residual(spark: SparkSession, sf: str) -> DataFrame:
    """HS3: no concept has a vector in the space of code here; the others have text or churn."""
    c = M.concepts(spark, sf)
    s = M.bindings(spark, sf).select(F.col("concept_id").alias("id"), "symbol_id", "confidence").join(_symbol_vectors(spark, sf), "symbol_id").select("id", "confidence", F.lit(None).cast("array<float>").alias("code"), F.col("vec").alias("text"))
    vecs = _concept_vectors(spark, sf)
    return rounded(U.ground_residuals(c, vecs.limit(0), vecs, s))


@query(with_("cur", "sym", "bind") + ", " + _BASE + f""", q AS (SELECT v AS q FROM cv ORDER BY id LIMIT 1), d AS (SELECT symbol_id, {S._cosine_sql('v', 'q')} AS distance FROM sv, q)
SELECT c.active_chunk_id AS chunk_id, min(d.distance) AS distance FROM d JOIN bind b ON b.symbol_id = d.symbol_id JOIN cur c ON c.id = b.concept_id WHERE c.active_chunk_id IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 20""")
def symbol_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """JN6, RT3."""
    q = S._vectors(spark, sf, S.CODE_MODEL).agg(F.min_by("vec", "id").alias("q"))
    c = M.concepts(spark, sf).select(F.col("id").alias("concept_id"), "active_chunk_id")
    return rounded(U.symbol_vector_search(_symbol_vectors(spark, sf), M.bindings(spark, sf), c, q, 20))


@query(with_("cur") + r""", w AS (SELECT cluster_id, unnest(list_distinct(list_filter(regexp_split_to_array(name, '[-_\s]+'), lambda x: length(x) > 2))) AS word FROM cur WHERE cluster_id IS NOT NULL AND name IS NOT NULL),
n AS (SELECT cluster_id, count(*) AS n FROM cur WHERE cluster_id IS NOT NULL GROUP BY 1), m AS (SELECT cluster_id, word, count(*) AS m FROM w GROUP BY 1, 2),
t AS (SELECT m.*, row_number() OVER (PARTITION BY m.cluster_id ORDER BY m DESC, word) AS rn FROM m JOIN n USING (cluster_id) WHERE m >= ceil(0.4::DOUBLE * n) QUALIFY rn <= 3)
SELECT n.cluster_id, n.n, coalesce(string_agg(word, ', ' ORDER BY rn), 'mixed') AS domain FROM n LEFT JOIN t USING (cluster_id) GROUP BY 1, 2""")
def cluster_naming(spark: SparkSession, sf: str) -> DataFrame:
    """SF23."""
    return U.cluster_names(M.concepts(spark, sf).where("cluster_id is not null"), "cluster_id", "name")


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "state_chunks").groupBy(ref_key("fl_id").alias("chunk_id")).agg(F.max(F.struct("fl_created_at", F.col("fl_cluster").alias("cluster"), F.col("fl_concept").alias("title"))).alias("r")).select("chunk_id", "r.cluster", "r.title")
    return s.join(S._vectors(spark, sf, S.TEXT_MODEL).select(F.col("id").alias("chunk_id"), "vec"), "chunk_id")


_CLUSTERED = f"""sc AS (SELECT {ref_sql('fl_id')} AS chunk_id, fl_cluster AS cluster, fl_concept AS title FROM state_chunks QUALIFY row_number() OVER (PARTITION BY {ref_sql('fl_id')} ORDER BY fl_created_at DESC NULLS LAST, fl_cluster DESC NULLS LAST, fl_concept DESC NULLS LAST) = 1),
cl AS (SELECT sc.*, tv.v FROM sc JOIN tv ON tv.id = sc.chunk_id)"""


@query(with_("cur", "sym") + ", " + _BASE + ", " + _CLUSTERED + r""", ow AS (SELECT DISTINCT cl.cluster FROM cl JOIN cur c ON """ + ref_sql("c.active_chunk_id") + r""" = cl.chunk_id WHERE c.status = 'active'),
orp AS (SELECT * FROM cl WHERE cluster IS NOT NULL AND cluster NOT IN (SELECT cluster FROM ow WHERE cluster IS NOT NULL)), n AS (SELECT cluster, count(*) AS n FROM orp GROUP BY 1),
w AS (SELECT cluster, unnest(list_distinct(list_filter(regexp_split_to_array(title, '[-_\s]+'), lambda x: length(x) > 2))) AS word FROM orp WHERE title IS NOT NULL), m AS (SELECT cluster, word, count(*) AS m FROM w GROUP BY 1, 2),
t AS (SELECT m.*, row_number() OVER (PARTITION BY m.cluster ORDER BY m DESC, word) AS rn FROM m JOIN n USING (cluster) WHERE m >= ceil(0.4::DOUBLE * n) QUALIFY rn <= 3), nm AS (SELECT n.cluster, n.n, string_agg(word, '-' ORDER BY rn) AS name FROM n LEFT JOIN t USING (cluster) GROUP BY 1, 2),
e AS (SELECT cluster, chunk_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM orp), ce AS (SELECT cluster, i, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT e.cluster, e.chunk_id, round(sum((e.x - ce.m) * (e.x - ce.m)), 9) AS d FROM e JOIN ce ON ce.cluster = e.cluster AND ce.i = e.i GROUP BY 1, 2)
SELECT nm.cluster, coalesce(nm.name, 'cluster-' || nm.cluster) AS name, b.chunk_id AS active_chunk_id, nm.n AS n_chunks FROM nm JOIN (SELECT cluster, chunk_id FROM d QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d, chunk_id) = 1) b ON b.cluster = nm.cluster""")
def concept_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """GR13: the concepts that clusters without one would become."""
    owners = M.concepts(spark, sf).where("status = 'active'").select(ref_key("active_chunk_id").alias("active_chunk_id"))
    return U.discovered(_clustered(spark, sf), owners)


@query(with_("sym") + ", " + _BASE + ", " + _CLUSTERED + """, u AS (SELECT cluster, list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0 END) AS u FROM cl WHERE cluster IS NOT NULL),
e AS (SELECT cluster, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u), m AS (SELECT cluster, i, avg(x) AS x FROM e GROUP BY 1, 2)
SELECT a.cluster AS a, b.cluster AS b, round(sum(a.x * b.x), 6) AS alpha FROM m a JOIN m b ON a.i = b.i AND a.cluster < b.cluster GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 6) > 0.1""")
def cluster_similarity_edges(spark: SparkSession, sf: str) -> DataFrame:
    """GR12: edges between clusters whose members are alike on the mean."""
    return rounded(U.cluster_edges(_clustered(spark, sf), -2.0)).where("alpha > 0.1")


@query("""WITH e AS (SELECT l_suppkey AS from_id, l_partkey AS to_id, year(l_shipdate) AS graph_version, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3) SELECT * FROM e WHERE graph_version = (SELECT max(graph_version) FROM e)""")
def edges_latest(spark: SparkSession, sf: str) -> DataFrame:
    """GR14."""
    e = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.year("l_shipdate").cast("long").alias("graph_version")).agg(F.sum("l_quantity").alias("weight"))
    return U.edges_of_latest(e, "graph_version")


_RUNS = "sg AS (SELECT strftime(inserted_at, '%Y-%m') AS run, id, max(inserted_at) AS created_at, arg_max(coalesce(staleness, 0), seq) AS final_stale FROM concepts WHERE inserted_at IS NOT NULL GROUP BY 1, 2), lr AS (SELECT run, max(created_at) AS created_at FROM sg GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1)"


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """The versions of a month stand for a run of the health signals."""
    c = table(spark, sf, "concepts").where("inserted_at is not null")
    return c.groupBy(F.date_format("inserted_at", "yyyy-MM").alias("run"), "id").agg(F.max("inserted_at").alias("created_at"), F.max_by(F.coalesce("staleness", F.lit(0.0)), "seq").alias("final_stale"))


@query("WITH " + _RUNS + " SELECT run, epoch_us(created_at) AS created_us FROM lr")
def latest_health_run(spark: SparkSession, sf: str) -> DataFrame:
    """AG8."""
    return U.latest_run(_signals(spark, sf)).select("run", micros("created_at").alias("created_us"))


@query(with_("cur") + ", " + _RUNS + " SELECT sg.id, c.name, round(final_stale, 6) AS final_stale FROM sg JOIN lr ON lr.run = sg.run JOIN cur c ON c.id = sg.id WHERE c.status = 'active' ORDER BY round(final_stale, 9) DESC, c.name, sg.id LIMIT 25")
def latest_signals(spark: SparkSession, sf: str) -> DataFrame:
    """JN15, SL5: names in binary order."""
    return rounded(U.latest_signals(_signals(spark, sf), M.concepts(spark, sf).where("status = 'active'"), 25).select("id", "name", "final_stale"))


_NEIGHBOURS = """fs AS (SELECT n_nationkey AS id, round((n_nationkey % 7) / 7.0::DOUBLE, 6) AS final_stale FROM nation),
nb AS (SELECT x.id, n.n_name AS concept, x.direction, x.weight, fs.final_stale, row_number() OVER (PARTITION BY x.id ORDER BY x.weight DESC, n.n_name, x.direction) AS pos FROM (
  SELECT from_id AS id, to_id AS other, 'outbound' AS direction, weight FROM rel WHERE active = 1 UNION ALL SELECT to_id, from_id, 'inbound', weight FROM rel WHERE active = 1 AND from_id <> to_id) x JOIN nation n ON n.n_nationkey = x.other LEFT JOIN fs ON fs.id = x.other)"""


def _final(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.round(F.col("n_nationkey") % 7 / 7, 6).alias("final_stale"))


def _nation_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("cluster"))


@query(with_("rel") + ", " + _NEIGHBOURS + " SELECT * FROM nb")
def health_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """HS13: nations stand for concepts, some of unknown staleness."""
    return U.health_neighbors(M.nations(spark, sf), _nation_concepts(spark, sf), _final(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(with_("rel") + ", " + _NEIGHBOURS + " SELECT fs.id, fs.final_stale, count(nb.id) AS n_neighbors, round(avg(nb.weight), 6) AS mean_weight, min(nb.concept) FILTER (pos = 1) AS heaviest FROM fs LEFT JOIN nb ON nb.id = fs.id GROUP BY 1, 2")
def health_explained(spark: SparkSession, sf: str) -> DataFrame:
    """HS13."""
    return rounded(U.explained(_final(spark, sf), M.nations(spark, sf), _nation_concepts(spark, sf)))


@query(with_("cur") + """, t AS (SELECT id, staleness, residual, staleness AS final_stale FROM cur WHERE staleness >= 0.6 ORDER BY staleness DESC, id LIMIT 5),
h AS (SELECT *, greatest(0, staleness - (0.2 + 0.3 * final_stale)) AS staleness_after, greatest(0, coalesce(residual, 0) - (0.12 + 0.25 * final_stale)) AS residual_after FROM t), c AS (SELECT *, (residual_after - coalesce(residual, 0)) / 1.2 AS change FROM h)
SELECT id, staleness, residual, final_stale, round(staleness_after, 6) AS staleness_after, round(residual_after, 6) AS residual_after, round(10 + sum(change) OVER w, 6) AS debt_after, 'healed' AS status, row_number() OVER w AS pos FROM c WINDOW w AS (ORDER BY final_stale DESC, id)""")
def heal_run(spark: SparkSession, sf: str) -> DataFrame:
    """HS15."""
    c = M.concepts(spark, sf).select("id", "staleness", "residual", F.col("staleness").alias("final_stale"))
    out = U.heal_run(c, 10.0, 0.2)
    return out.select("id", "staleness", "residual", "final_stale", *[F.round(x, 6).alias(x) for x in ("staleness_after", "residual_after", "debt_after")], "status", F.col("pos").cast("long").alias("pos"))


@query(with_("cur", "sym") + ", " + _BASE + f""", nc AS (SELECT DISTINCT s.fl_narrative_origin AS narrative, {ref_sql('s.fl_concept_id')} AS id, tv.id AS chunk, tv.v FROM state_chunks s JOIN tv ON tv.id = {ref_sql('s.fl_id')} WHERE s.fl_narrative_origin IS NOT NULL AND {ref_sql('s.fl_concept_id')} IS NOT NULL),
e AS (SELECT narrative, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM nc), ce AS (SELECT narrative, list(m ORDER BY i) AS m FROM (SELECT narrative, i, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1), cvv AS (SELECT c.id, tv.v FROM cur c JOIN tv ON tv.id = {ref_sql('c.active_chunk_id')}),
d AS (SELECT p.narrative, p.id, {S._cosine_sql('cvv.v', 'ce.m')} AS distance FROM (SELECT DISTINCT narrative, id FROM nc) p JOIN ce ON ce.narrative = p.narrative JOIN cvv ON cvv.id = p.id)
SELECT narrative, id, distance, CASE WHEN distance > 0.75 THEN 'structural' WHEN distance > 0.6 THEN 'strong' ELSE 'transition' END AS phase FROM d WHERE distance >= 0.45""")
def phase_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """HS17."""
    s = table(spark, sf, "state_chunks").select(F.col("fl_narrative_origin").alias("narrative"), ref_key("fl_concept_id").alias("id"), ref_key("fl_id").alias("chunk")).where("narrative is not null and id is not null").distinct()
    chunks = s.join(S._vectors(spark, sf, S.TEXT_MODEL).select(F.col("id").alias("chunk"), "vec"), "chunk")
    return rounded(U.phase_transitions(chunks, _concept_vectors(spark, sf)))


@query("SELECT c_custkey AS id, round(c_acctbal / 300, 6) AS debt, CASE WHEN c_acctbal / 300 >= 25 THEN 'critical' WHEN c_acctbal / 300 >= 10 THEN 'degrading' ELSE 'healthy' END AS health FROM customer")
def manifest_health(spark: SparkSession, sf: str) -> DataFrame:
    """HS20."""
    return rounded(U.manifest_health(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 300).alias("debt"))))


@query(with_("cur", "sym", "bind", "jobs") + f""", n AS (SELECT id, status, entry_count, opened_at FROM (SELECT coalesce({ref_sql('fl_narrative_origin')}, '') AS id, 'open' AS status, count(*) AS entry_count, min(fl_created_at) AS opened_at FROM state_chunks WHERE fl_narrative_origin IS NOT NULL GROUP BY 1))
SELECT 'concepts' AS section, 'active' AS item, round(count(*) FILTER (status = 'active')::DOUBLE, 6) AS value FROM cur UNION ALL SELECT 'concepts', 'all', count(*)::DOUBLE FROM cur
UNION ALL SELECT 'debt', 'debt', round(sum(0.6 * coalesce(ground_residual, churn, 0) + 0.4 * coalesce(lore_residual, 0)), 6) FROM cur WHERE status = 'active'
UNION ALL SELECT 'coverage', 'bound', count(DISTINCT b.symbol_id)::DOUBLE FROM bind b JOIN sym s ON s.id = b.symbol_id UNION ALL SELECT 'coverage', 'symbols', count(*)::DOUBLE FROM sym
UNION ALL SELECT 'narratives', 'open', count(*)::DOUBLE FROM n UNION ALL SELECT 'narratives', 'dangling', count(*) FILTER (date_diff('second', opened_at, TIMESTAMP '{NOW}') > 259200)::DOUBLE FROM n
UNION ALL SELECT 'jobs', 'queued', count(*) FILTER (status = 'queued')::DOUBLE FROM jobs UNION ALL SELECT 'jobs', 'leased', count(*) FILTER (status = 'leased')::DOUBLE FROM jobs""")
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    """HS18, SG5."""
    c = M.concepts(spark, sf)
    one = c.agg(F.lit("concepts").alias("section"), F.count_if(F.col("status") == "active").alias("active"), F.count("*").alias("all"))
    debt = H.total_debt(c.where("status = 'active'"), 0.0).select(F.lit("debt").alias("section"), "debt")
    s = M.symbols(spark, sf).select(F.col("id").alias("symbol_id"))
    bound = M.bindings(spark, sf).join(s, "symbol_id").agg(F.count_distinct("symbol_id").alias("bound"))
    cover = bound.join(s.agg(F.count("*").alias("symbols"))).select(F.lit("coverage").alias("section"), "bound", "symbols")  # one row each
    n = table(spark, sf, "state_chunks").where("fl_narrative_origin is not null").groupBy(F.coalesce(ref_key("fl_narrative_origin"), F.lit("")).alias("id")).agg(F.lit("open").alias("status"), F.count("*").alias("entry_count"), F.min("fl_created_at").alias("opened_at"))
    hy = H.hygiene(n, M.now()).select(F.lit("narratives").alias("section"), "open", "dangling")
    jobs = M.jobs(spark, sf).agg(F.lit("jobs").alias("section"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "leased").alias("leased"))
    return U.status_report(one, debt, cover, hy, jobs)


@query(with_("jobs") + " SELECT false AS refresh, count(*) FILTER (status IN ('queued', 'leased')) AS pending FROM jobs")
def refresh_guard(spark: SparkSession, sf: str) -> DataFrame:
    """QU6: the graph is stale, but jobs are pending."""
    return U.needs_refresh(spark.range(1).select(F.lit(1).alias("graph_stale")), M.jobs(spark, sf))


@query(with_("rel") + r""", w AS (SELECT n_regionkey AS cluster, unnest(list_distinct(list_filter(regexp_split_to_array(n_name, '[-_\s]+'), lambda x: length(x) > 2))) AS word FROM nation), n AS (SELECT n_regionkey AS cluster, count(*) AS n FROM nation GROUP BY 1), m AS (SELECT cluster, word, count(*) AS m FROM w GROUP BY 1, 2),
t AS (SELECT m.*, row_number() OVER (PARTITION BY cluster ORDER BY m DESC, word) AS rn FROM m JOIN n USING (cluster) WHERE m >= ceil(0.4::DOUBLE * n) QUALIFY rn <= 3), nm AS (SELECT n.cluster, n.n, coalesce(string_agg(word, ', ' ORDER BY rn), 'mixed') AS domain FROM n LEFT JOIN t USING (cluster) GROUP BY 1, 2),
r AS (SELECT id, count(*) AS k FROM (SELECT from_id AS id FROM rel WHERE active = 1 UNION ALL SELECT to_id FROM rel WHERE active = 1) GROUP BY 1) SELECT n_nationkey AS id, nm.cluster, nm.n - 1 AS n_peers, nm.domain, coalesce(r.k, 0) AS n_relations FROM nation JOIN nm ON nm.cluster = n_regionkey LEFT JOIN r ON r.id = n_nationkey""")
def cluster_peers(spark: SparkSession, sf: str) -> DataFrame:
    """RT15."""
    return U.peers(_nation_concepts(spark, sf), M.nations(spark, sf))


# suggestions

_SETTLE = f"""nr AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'closing' WHEN 'MACHINERY' THEN 'close_failed' WHEN 'AUTOMOBILE' THEN 'closed' ELSE 'open' END AS status, count(o_orderkey) AS entry_count, coalesce(min(o_orderdate), TIMESTAMP '2025-12-30') AS opened_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
st AS (SELECT id, CASE WHEN status IN ('closing', 'close_failed') THEN 'close-narrative' WHEN status = 'open' AND date_diff('second', opened_at::TIMESTAMP, TIMESTAMP '{NOW}') > 259200 THEN CASE WHEN entry_count > 0 THEN 'close-narrative' ELSE 'abandon-narrative' END END AS kind FROM nr)"""


@query("WITH " + _SETTLE + " SELECT id, kind, 1.0::DOUBLE AS confidence FROM st WHERE kind IS NOT NULL")
def suggest_narratives(spark: SparkSession, sf: str) -> DataFrame:
    """SG1: customers stand for narratives, their orders for entries."""
    status = F.create_map(*[F.lit(x) for kv in {"BUILDING": "closing", "MACHINERY": "close_failed", "AUTOMOBILE": "closed"}.items() for x in kv])
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    n = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left").groupBy(F.col("c_custkey").alias("id"), "c_mktsegment")
    n = n.agg(F.count("o_orderkey").alias("entry_count"), F.min("o_orderdate").cast("timestamp_ntz").alias("opened_at")).withColumn("status", F.coalesce(status[F.col("c_mktsegment")], F.lit("open")))
    return SG.narratives_to_settle(n.withColumn("opened_at", F.coalesce("opened_at", F.to_timestamp_ntz(F.lit("2025-12-30 00:00:00")))), M.now())


_MERGES = f"mr AS (SELECT DISTINCT id AS from_id, {ref_sql('merged_into_concept_id')} AS to_id FROM concepts WHERE {ref_sql('merged_into_concept_id')} IS NOT NULL)"


@query(with_("cur") + ", " + _MERGES + " SELECT mr.to_id AS id, mr.from_id, 'clean-relation' AS kind, 1.0::DOUBLE AS confidence FROM mr JOIN cur c ON c.id = mr.to_id WHERE c.status <> 'active'")
def suggest_clean_relation(spark: SparkSession, sf: str) -> DataFrame:
    """SG1: links to concepts that are not active."""
    r = table(spark, sf, "concepts").select(F.col("id").alias("from_id"), ref_key("merged_into_concept_id").alias("to_id")).where("to_id is not null").distinct()
    return SG.relations_to_clean(r, M.concepts(spark, sf).select("id", "status"))


_KINDS = """k AS (SELECT id, 'review' AS kind, residual AS confidence, 0 AS priority FROM cur WHERE residual > 0.65 AND status = 'active' UNION ALL SELECT id, 'cluster-drift', lore_residual, 1 FROM cur WHERE status = 'active' AND lore_residual > 0.55 AND ground_residual < 0.35),
im AS (SELECT k.*, (0.6 * coalesce(ground_residual, churn, 0) + 0.4 * coalesce(c.lore_residual, 0)) * CASE kind WHEN 'review' THEN 0.8 ELSE 0.3 END / 1.2 AS raw_reduction FROM k JOIN cur c ON c.id = k.id), im2 AS (SELECT *, raw_reduction / 100 * 60 AS reduction FROM im)"""
_REDUCERS = {"review": 0.8, "cluster-drift": 0.3}


def _ranked_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    c = M.concepts(spark, sf).where("status = 'active'")
    kinds = SG.review(c).withColumn("priority", F.lit(0)).unionByName(SG.cluster_drift(c).withColumn("priority", F.lit(1)))
    return SG.with_impact(kinds, c.select("id", H.base_pressure().alias("pressure")), _REDUCERS, 0.2, 100.0, 60.0)


@query(with_("cur") + ", " + _KINDS + " SELECT id, kind, round(confidence, 6) AS confidence, round(reduction, 6) AS reduction FROM im2 WHERE kind = 'cluster-drift'")
def suggestions_of_kind(spark: SparkSession, sf: str) -> DataFrame:
    """PF11."""
    return rounded(SG.of_kinds(_ranked_suggestions(spark, sf), ["cluster-drift"]).select("id", "kind", "confidence", "reduction"))


@query(with_("cur") + ", " + _KINDS + """, t AS (SELECT * FROM im2 WHERE round(reduction, 9) > 0 ORDER BY round(reduction, 9) DESC, priority, confidence DESC, id, kind LIMIT 3)
SELECT id, kind, round(reduction, 6) AS reduction, row_number() OVER w AS pos, round(greatest(0, 60 - sum(reduction) OVER w), 6) AS debt_left FROM t WINDOW w AS (ORDER BY round(reduction, 9) DESC, priority, confidence DESC, id, kind)""")
def debt_reducers(spark: SparkSession, sf: str) -> DataFrame:
    """SL4, SG1: the projection of the debt after the three best."""
    out = SG.debt_reducers(_ranked_suggestions(spark, sf), 60.0)
    return rounded(out.select("id", "kind", "reduction", F.col("pos").cast("long").alias("pos"), "debt_left"))


_PRESSURE = "greatest(0.6 * coalesce(ground_residual, churn, 0) + 0.4 * coalesce(lore_residual, 0), coalesce(staleness, 0), 0)"


@query(with_("cur", "sym", "bind") + f""", ca AS (SELECT *, {_PRESSURE} AS p FROM cur WHERE status = 'active'), hs AS (SELECT greatest(0, least(1, sum(coalesce(staleness, 0) * greatest(0.001, p)) / sum(greatest(0.001, p)))) AS v FROM (SELECT * FROM ca ORDER BY p DESC, id LIMIT 20)),
dr AS (SELECT avg((b.bound_body_hash IS DISTINCT FROM s.body_hash)::INT::DOUBLE) AS v FROM bind b JOIN sym s ON s.id = b.symbol_id),
st AS (SELECT file_path, content_hash AS d FROM source_files), fo AS (SELECT fl_source_file AS file_path, max(fl_body_hash) AS d FROM source_chunks WHERE fl_source_file IS NOT NULL GROUP BY 1),
cf AS (SELECT avg((fo.file_path IS NULL OR st.d IS DISTINCT FROM fo.d)::INT::DOUBLE) AS v FROM st LEFT JOIN fo ON fo.file_path = st.file_path),
df AS (SELECT avg((m < TIMESTAMP '{NOW}' - INTERVAL 180 DAY)::INT::DOUBLE) AS v FROM (SELECT fl_id, max(fl_created_at) AS m FROM doc_chunks GROUP BY 1)),
cg AS (SELECT 1 - (SELECT count(DISTINCT b.symbol_id) FROM bind b JOIN sym s ON s.id = b.symbol_id)::DOUBLE / count(*) AS v FROM sym),
em AS (SELECT avg((e.id IS NULL)::INT::DOUBLE) AS v FROM (SELECT {ref_sql('fl_id')} AS id, arg_max({code_sql('fl_embedding_model')}, struct_pack(t := fl_created_at, m := {code_sql('fl_embedding_model')})) AS model FROM state_chunks GROUP BY 1) c LEFT JOIN (SELECT DISTINCT {ref_sql('chunk_id')} AS id, {code_sql('model')} AS model FROM chunk_embeddings) e ON e.id = c.id AND e.model = c.model),
nr AS (SELECT {ref_sql('fl_narrative_origin')} AS id, count(*) AS n, min(fl_created_at) AS o FROM state_chunks WHERE {ref_sql('fl_narrative_origin')} IS NOT NULL GROUP BY 1),
hy AS (SELECT greatest(0, least(1, 2 * k / greatest(4, n + 2 * k))) AS v FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (date_diff('second', o, TIMESTAMP '{NOW}') > 259200)::DOUBLE AS k FROM nr)),
pp AS (SELECT t.v AS t, a.m, a.h, CASE WHEN a.m > 0 THEN greatest(0, least(1, (t.v - a.m) / greatest(0.1, 1 - a.m))) ELSE greatest(0, least(1, t.v)) END AS k FROM (SELECT avg(p) AS v FROM (SELECT p FROM ca ORDER BY p DESC, id LIMIT 5)) t, (SELECT avg(p) AS m, avg((p >= 0.4)::INT::DOUBLE) AS h FROM ca) a),
co AS (SELECT hs.v AS staleness, dr.v AS symbol_drift, cf.v AS code_freshness, df.v AS doc_freshness, cg.v AS coverage_gap, em.v AS embedding_mismatch, hy.v AS hygiene, greatest(0, least(1, 0.65 * pp.t + 0.2 * pp.h + 0.15 * pp.k)) AS priority_pressure FROM hs, dr, cf, df, cg, em, hy, pp),
de AS (SELECT *, greatest(0, least(100, 100 * (0.27 * staleness + 0.23 * symbol_drift + 0.18 * code_freshness + 0.08 * doc_freshness + 0.10 * coverage_gap + 0.04 * embedding_mismatch + 0.05 * hygiene + 0.05 * priority_pressure))) AS debt FROM co)
SELECT round(staleness, 6) AS staleness, round(symbol_drift, 6) AS symbol_drift, round(code_freshness, 6) AS code_freshness, round(doc_freshness, 6) AS doc_freshness, round(coverage_gap, 6) AS coverage_gap, round(embedding_mismatch, 6) AS embedding_mismatch, round(hygiene, 6) AS hygiene, round(priority_pressure, 6) AS priority_pressure,
  round(debt, 6) AS debt, round(100 - debt, 6) AS confidence, CASE WHEN debt <= 25 THEN 'healthy' WHEN debt <= 50 THEN 'caution' WHEN debt <= 75 THEN 'high' ELSE 'critical' END AS band FROM de""")
def ask_debt_live(spark: SparkSession, sf: str) -> DataFrame:
    """HS9: the eight components from the tables themselves, one row each, and the debt they make."""
    c = M.concepts(spark, sf).where("status = 'active'").withColumn("drift", F.lit(None).cast("double"))
    s, b = M.symbols(spark, sf), M.bindings(spark, sf)
    share = lambda cond, name: F.avg(cond.cast("int").cast("double")).alias(name)
    bound = b.select("symbol_id", "bound_body_hash").join(s.select(F.col("id").alias("symbol_id"), "body_hash"), "symbol_id")
    drift = bound.agg(share(~F.col("bound_body_hash").eqNullSafe(F.col("body_hash")), "symbol_drift"), F.count_distinct("symbol_id").alias("__bound"))
    stored = table(spark, sf, "source_files").select("file_path", F.col("content_hash").alias("digest"))
    found = table(spark, sf, "source_chunks").where("fl_source_file is not null").groupBy(F.col("fl_source_file").alias("file_path")).agg(F.max("fl_body_hash").alias("digest"))
    code = CH.rescan(stored, found).where("action <> 'add'").agg(share(F.col("action") != "skip", "code_freshness"))
    doc = table(spark, sf, "doc_chunks").groupBy("fl_id").agg(F.max("fl_created_at").alias("m")).agg(share(F.col("m") < M.now() - F.expr("INTERVAL 180 DAYS"), "doc_freshness"))
    n = s.agg(F.count("*").alias("__symbols"))
    model = table(spark, sf, "state_chunks").groupBy(ref_key("fl_id").alias("id")).agg(F.max(F.struct("fl_created_at", code_key("fl_embedding_model").alias("model")))["model"].alias("model"))
    held = table(spark, sf, "chunk_embeddings").select(ref_key("chunk_id").alias("id"), code_key("model").alias("model"), F.lit(True).alias("there")).distinct()
    mismatch = model.join(held, ["id", "model"], "left").agg(share(F.col("there").isNull(), "embedding_mismatch"))
    narr = table(spark, sf, "state_chunks").groupBy(ref_key("fl_narrative_origin").alias("id")).agg(F.lit("open").alias("status"), F.count("*").alias("entry_count"), F.min("fl_created_at").alias("opened_at")).where("id is not null")
    one = H.hot_staleness(c).withColumnRenamed("hot_staleness", "staleness")
    for part in (drift, code, doc, n, mismatch, H.hygiene(narr, M.now()).select(F.col("risk").alias("hygiene")), H.priority_pressure(c)):
        one = one.join(F.broadcast(part))  # one row each
    one = one.withColumn("coverage_gap", 1 - F.col("__bound") / F.col("__symbols"))
    return rounded(H.ask_debt(one.drop("__bound", "__symbols")).drop("retrieval_multiplier", "staleness_multiplier").select(*H.ASK_WEIGHTS, "debt", "confidence", "band"))


@query("""WITH l AS (SELECT max(ts) AS t FROM events) SELECT event_type, count(*) FILTER (ts > t - INTERVAL 72 HOUR) AS in_72h, count(*) FILTER (ts > t - INTERVAL 14 DAY) AS in_14d, count(*) FILTER (ts > t - INTERVAL 30 DAY) AS in_30d FROM events, l GROUP BY 1""")
def interaction_windows(spark: SparkSession, sf: str) -> DataFrame:
    """QU7: events of the last 72 hours, 14 and 30 days before the last one."""
    e = table(spark, sf, "events")
    j = e.join(F.broadcast(e.agg(F.max("ts").alias("t"))))  # one row
    n = lambda span, name: F.count_if(F.col("ts") > F.col("t") - F.expr(f"INTERVAL {span}")).alias(name)
    return j.groupBy("event_type").agg(n("72 HOURS", "in_72h"), n("14 DAYS", "in_14d"), n("30 DAYS", "in_30d"))
