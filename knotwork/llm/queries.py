"""Queries of the data problems tagged llm and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.bpe import count_tokens, decoded, encode
from knotwork.llm.clusters import similarity_clusters
from knotwork.llm.groups import named_groups
from knotwork.llm.mixing import mix
from knotwork.llm.neighbors import nearest
from knotwork.llm.sentences import sentence_units
from knotwork.llm.splitting import split_items
from knotwork.plans.data_problems import latest_rows
from knotwork.tables import code_key, code_sql, ref_key, ref_sql, table


def _current_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """id and the id it was merged into, of each concept's current version."""
    c = table(spark, sf, "concepts").select("seq", "version_id", "id", "inserted_at", ref_key("merged_into_concept_id").alias("into")).where("id is not null")
    group = F.coalesce(F.concat(F.lit("v"), "version_id"), F.concat(F.lit("s"), F.col("seq").cast("string"), F.lit("k"), "id"))
    counted = c.groupBy(group.alias("g")).agg(F.max_by(F.struct("id", "inserted_at", "seq", "into"), "seq").alias("r")).select("r.*")
    return counted.groupBy("id").agg(F.max(F.struct("inserted_at", "seq", "into")).alias("r")).select("id", F.col("r.into").alias("into"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every concept of a group of two or more, with the group's size."""
    now = _current_concepts(spark, sf)
    g = named_groups(spark, now.select("id"), now.select(F.col("id").alias("a"), F.col("into").alias("b")))
    return g.select(F.col("id").alias("concept_id"), "group_id", "n_members")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_groups(spark, sf).select("concept_id", "group_id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """The current source and doc chunks above their limits.

    Which row of an item counts - the latest, of these the longest, then the one of the greatest md5 - is found
    on rows without their text; only texts above their limit are shuffled.
    """
    s = table(spark, sf, "source_chunks").select(F.lit("source_chunks").alias("item_table"), F.col("fl_id").alias("item_id"), "fl_created_at", code_key("fl_type").alias("t"), code_key("fl_language").alias("l"), F.col("fl_line_start").alias("first_line"), F.col("body").alias("content"))
    d = table(spark, sf, "doc_chunks").select(F.lit("doc_chunks").alias("item_table"), F.col("fl_id").alias("item_id"), "fl_created_at", code_key("fl_type").alias("t"), F.lit(None).cast("string").alias("l"), F.lit(1).alias("first_line"), "content")
    limits = table(spark, sf, "split_limits").select(code_key("fl_type").alias("lt"), code_key("fl_language").alias("ll"), "max_chars", "overlap_chars")  # a fixed table of few rows
    own = F.broadcast(limits.where("ll is not null").select("lt", "ll", F.col("max_chars").alias("m1"), F.col("overlap_chars").alias("o1")))
    rest = F.broadcast(limits.where("ll is null").select(F.col("lt").alias("rt"), F.col("max_chars").alias("m2"), F.col("overlap_chars").alias("o2")))
    rows = s.unionByName(d).where("item_id is not null").join(own, (F.col("t") == F.col("lt")) & (F.col("l") == F.col("ll")), "left").join(rest, F.col("t") == F.col("rt"), "left")
    rows = rows.withColumn("max_chars", F.coalesce("m1", "m2")).withColumn("overlap_chars", F.when(F.col("m1").isNotNull(), F.col("o1")).otherwise(F.col("o2")))
    rows = rows.withColumn("big", F.coalesce((F.col("max_chars") > 0) & (F.length("content") > F.col("max_chars")), F.lit(False)))
    rows = rows.withColumn("order", F.struct("fl_created_at", F.length("content").alias("n"), F.md5(F.col("content").cast("binary")).alias("m"), "first_line", "max_chars", "overlap_chars"))
    newest = rows.groupBy("item_table", "item_id").agg(F.max(F.struct("order", "big")).alias("r")).where("r.big").select("item_table", "item_id", F.col("r.order").alias("newest"))
    texts = rows.where("big").join(newest, ["item_table", "item_id"]).where(F.col("order") == F.col("newest")).dropDuplicates(["item_table", "item_id"])
    return texts.select("item_table", "item_id", "content", "first_line", "max_chars", "overlap_chars")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of all items above their limit."""
    return split_items(_items(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_pieces(spark, sf).where("piece = 0").select("item_table", "item_id")


def p2_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Each item put together again from its pieces: its text without the overlaps, its lines, and the number of pieces above the limit or out of order."""
    limits = _items(spark, sf).select("item_table", "item_id", "max_chars")
    p = p2_pieces(spark, sf).join(limits, ["item_table", "item_id"])
    part = F.struct("piece", F.col("start_char"), F.col("end_char"), F.expr("substring(body, overlap + 1)").alias("new"), "line_start", "line_end")
    whole = p.groupBy("item_table", "item_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.sum((F.length("body") > F.col("max_chars")).cast("int")).alias("long"))  # the pieces of one text
    text = F.array_join("p.new", "")
    gaps = F.expr("size(filter(p, (x, i) -> x.piece <> i or i > 0 and x.start_char > p[i - 1].end_char))")
    return whole.select("item_table", "item_id", F.md5(text.cast("binary")).alias("content_md5"), F.length(text).cast("long").alias("n_chars"), (F.col("long") + gaps).cast("int").alias("n_faults"), F.col("p")[0]["line_start"].alias("line_start"), F.element_at("p", -1)["line_end"].alias("line_end"))


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    models = table(spark, sf, "embed_models")
    named = F.broadcast(models.select(code_key("model").alias("key"), "model"))  # a fixed table of few rows
    states = table(spark, sf, "state_chunks").select(ref_key("fl_id").alias("chunk"), code_key("fl_embedding_model").alias("key"), "fl_created_at")
    wanted = latest_rows(states, "chunk", "fl_created_at", "key").join(named, "key").select(F.col("id").alias("chunk"), "model")
    return similarity_clusters(spark, table(spark, sf, "chunk_embeddings"), models, wanted)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)[0].select(F.col("chunk").alias("chunk_id"), "cluster_id")


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster with its size and its three most typical chunks."""
    return _clusters(spark, sf)[1].select("cluster_id", "model", "size", "n_communities", F.array_join("typical", " ").alias("typical_chunks"))


def p5_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The size of each cluster, as p5_clusters has it."""
    return p5_clusters(spark, sf).select("cluster_id", F.col("size"))


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(spark, table(spark, sf, "chunk_embeddings"), table(spark, sf, "embed_models"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    n = _nearest(spark, sf).select("model", F.col("chunk").alias("q"), F.explode("near.chunk").alias("o"))
    return n.select("model", F.least("q", "o").alias("chunk_a"), F.greatest("q", "o").alias("chunk_b")).distinct()


def p6_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest chunks of every chunk, with rank and cosine."""
    n = _nearest(spark, sf).select("model", F.col("chunk").alias("chunk_id"), F.posexplode("near").alias("pos", "n"))
    return n.select("model", "chunk_id", (F.col("pos") + 1).alias("rank"), F.col("n.chunk").alias("neighbor_id"), (-F.col("n.minus")).alias("cosine"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(spark, table(spark, sf, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The text that the ids of each document stand for, by its hash."""
    return decoded(spark, p8_ids(spark, sf), "doc_id").select("doc_id", F.md5("data").alias("text_md5"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The number of tokens of every document."""
    return count_tokens(spark, table(spark, sf, "documents"), ["doc_id"], "text")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", code_key("source").alias("source"), "text")
    targets = table(spark, sf, "mix_targets").withColumn("source", code_key("source"))
    return mix(spark, count_tokens(spark, docs, ["doc_id", "source"], "text"), targets)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_units(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt, "p5_found": p5_found, "p5_clusters": p5_clusters, "p5_sizes": p5_sizes, "p6_found": p6_found, "p6_neighbors": p6_neighbors, "p8_ids": p8_ids, "p8_counts": p8_counts, "p8_decoded": p8_decoded, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}

_GROUPS = f"""
WITH RECURSIVE counted AS (SELECT * FROM concepts QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY seq DESC) = 1),
now AS (SELECT id, {ref_sql('merged_into_concept_id')} AS t FROM counted QUALIFY row_number() OVER (PARTITION BY id ORDER BY inserted_at DESC, seq DESC) = 1),
link AS (SELECT id AS a, t AS b FROM now WHERE t <> id UNION SELECT t, id FROM now WHERE t <> id),
reach AS (SELECT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
groups AS (SELECT r.a AS concept_id, min(r.b) AS group_id, count(*) AS n_members FROM reach r WHERE r.a IN (SELECT id FROM now) AND r.b IN (SELECT id FROM now) GROUP BY 1 HAVING count(*) > 1)
"""
_NEAR = f"""
WITH m AS (SELECT {code_sql('model')} AS k, model, dim FROM embed_models),
ok AS (SELECT {ref_sql('e.chunk_id')} AS chunk, m.model, e.embedding::DOUBLE[] AS v, e.embedded_at, e.id FROM chunk_embeddings e JOIN m ON {code_sql('e.model')} = m.k
  WHERE len(e.embedding) = m.dim AND {ref_sql('e.chunk_id')} IS NOT NULL AND len(list_filter(e.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0),
v AS (SELECT chunk, model, v FROM ok QUALIFY row_number() OVER (PARTITION BY chunk, model ORDER BY embedded_at DESC NULLS LAST, id DESC NULLS LAST) = 1),
s AS (SELECT a.model, a.chunk AS q, b.chunk AS o, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM v a JOIN v b ON a.model = b.model AND a.chunk <> b.chunk),
n AS (SELECT *, row_number() OVER (PARTITION BY model, q ORDER BY c DESC, o) AS rank FROM s WHERE c >= 0.8 QUALIFY rank <= 5)
"""
_ALIKE = _NEAR.replace("WITH m", "WITH RECURSIVE m").split("n AS (SELECT *, row_number() OVER (PARTITION BY model, q")[0] + f"""
w AS (SELECT {ref_sql('fl_id')} AS chunk, arg_max({code_sql('fl_embedding_model')}, fl_created_at) AS k FROM state_chunks GROUP BY 1),
t AS (SELECT w.chunk, m.model FROM w JOIN m ON w.k = m.k),
e AS (SELECT s.model, s.q, s.o FROM s JOIN t a ON a.chunk = s.q AND a.model = s.model JOIN t b ON b.chunk = s.o AND b.model = s.model WHERE s.c >= 0.8),
reach AS (SELECT model, q, q AS o FROM e UNION SELECT r.model, r.q, e.o FROM reach r JOIN e ON e.model = r.model AND e.q = r.o)
SELECT q AS chunk_id, min(o) AS cluster_id FROM reach GROUP BY model, q HAVING count(*) >= 5
"""
_TOO_LONG = f"""
WITH rows AS (
  SELECT 'source_chunks' AS item_table, fl_id, fl_created_at, {code_sql('fl_type')} AS t, {code_sql('fl_language')} AS l, fl_line_start AS first_line, body AS content FROM source_chunks
  UNION ALL SELECT 'doc_chunks', fl_id, fl_created_at, {code_sql('fl_type')}, NULL, 1, content FROM doc_chunks),
newest AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY item_table, fl_id ORDER BY fl_created_at DESC, length(content) DESC, md5(content) DESC, first_line DESC) = 1),
lim AS (SELECT {code_sql('fl_type')} AS t, {code_sql('fl_language')} AS l, max_chars FROM split_limits),
big AS (SELECT n.item_table, n.fl_id AS item_id, n.content, n.first_line, coalesce(a.max_chars, b.max_chars) AS max_chars FROM newest n LEFT JOIN lim a ON a.t = n.t AND a.l = n.l LEFT JOIN lim b ON b.t = n.t AND b.l IS NULL
WHERE length(n.content) > coalesce(a.max_chars, b.max_chars))
"""

ORACLES = {
    "p1_found": _GROUPS + "SELECT concept_id, group_id FROM groups",
    "p1_groups": _GROUPS + "SELECT * FROM groups",
    "p2_found": _TOO_LONG + "SELECT item_table, item_id FROM big",
    "p2_rebuilt": _TOO_LONG + """SELECT item_table, item_id, md5(content) AS content_md5, length(content) AS n_chars, 0 AS n_faults, coalesce(first_line, 1) AS line_start,
  CAST(coalesce(first_line, 1) + length(regexp_replace(substr(content, 1, length(content) - 1), '\\r\\n|\\r|\\n', chr(1) || chr(1), 'g')) - length(regexp_replace(substr(content, 1, length(content) - 1), '\\r\\n|\\r|\\n', chr(1), 'g')) AS INTEGER) AS line_end FROM big""",
    "p5_sizes": "SELECT cluster_id, count(*) AS size FROM (" + _ALIKE + ") GROUP BY 1",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p5_found": _ALIKE,
    "p6_found": _NEAR + "SELECT DISTINCT model, least(q, o) AS chunk_a, greatest(q, o) AS chunk_b FROM n",
    "p6_neighbors": _NEAR + "SELECT model, q AS chunk_id, CAST(rank AS INTEGER) AS rank, o AS neighbor_id, c AS cosine FROM n",
}
