"""Queries over procedural text operators, sources and streams, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators import texts as T
from knotwork.plans import mapping as M
from knotwork.plans.mapping import with_
from knotwork.scratch import Scratch
from knotwork.sources import chunks as SC
from knotwork.sources import code as CODE
from knotwork.streaming import interactions as ST
from knotwork.tables import code_key, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "doc_chunks").where("content is not null").groupBy("fl_id").agg(F.max_by("content", "fl_created_at").alias("content"))
    return T.markdown_chunks(d, "fl_id", "content", 300)


@query()
def line_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The changes between a source chunk's bodies as it was written again."""
    w = Window.partitionBy("fl_id").orderBy("fl_created_at", F.coalesce("body", F.lit("")))
    s = table(spark, sf, "source_chunks").select("fl_id", "fl_created_at", "body").withColumn("old", F.lag("body").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1 and not (old <=> body)")
    return T.line_diffs(s.select(F.concat_ws("/", "fl_id", "n").alias("key"), "old", F.col("body").alias("new")), "key")


@query()
def callsite_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 20).alias("file"), (F.col("l_orderkey") % 2_000).cast("int").alias("line"))
    return T.coalesced_sites(s)


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_]+'))) AS name FROM documents), n AS (SELECT DISTINCT name, id AS name_id FROM symbols WHERE length(name) >= 3)
SELECT DISTINCT doc_id, name_id, 0.5::DOUBLE AS confidence FROM w JOIN n USING (name)""")
def mention_bind(spark: SparkSession, sf: str) -> DataFrame:
    return T.mentions(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "symbols").select("name", F.col("id").alias("name_id")))


@query(with_("sym", "bind") + """, f AS (SELECT DISTINCT b.concept_id, s.source_file_id FROM bind b JOIN sym s ON s.id = b.symbol_id WHERE b.confidence >= 0.9)
SELECT f.concept_id, s.id AS symbol_id, 0.8::DOUBLE AS confidence FROM f JOIN sym s USING (source_file_id) WHERE NOT EXISTS (SELECT 1 FROM bind b WHERE b.confidence >= 0.9 AND b.concept_id = f.concept_id AND b.symbol_id = s.id)""")
def autobind_file_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return T.file_overlap(M.bindings(spark, sf).where("confidence >= 0.9"), M.symbols(spark, sf))


@query("""WITH e AS (SELECT DISTINCT lower(trim(source)) AS grp, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS word FROM documents WHERE fl_type = 'journal' AND source IS NOT NULL),
b AS (SELECT doc_id AS block_id, lower(trim(source)) AS grp, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 2))) AS word FROM documents WHERE fl_type = 'chunk' AND source IS NOT NULL)
SELECT block_id, b.grp, count(*) AS shared FROM b JOIN e ON e.grp = b.grp AND e.word = b.word GROUP BY 1, 2""")
def block_overlap(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", F.lower(F.trim("source")).alias("grp"), "text", "fl_type")
    return T.block_overlap(d.where("fl_type = 'chunk'").withColumnRenamed("doc_id", "block_id"), d.where("fl_type = 'journal'"))


@query(with_("chunks") + """, g AS (SELECT DISTINCT supersedes_id FROM chunks WHERE supersedes_id IS NOT NULL), c AS (SELECT c.*, g.supersedes_id IS NULL AS live FROM chunks c LEFT JOIN g ON g.supersedes_id = c.id WHERE concept_id IS NOT NULL)
SELECT concept_id, id AS active_chunk_id, count(*) OVER (PARTITION BY concept_id) AS n_versions FROM c QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY live DESC, fl_created_at DESC, id DESC) = 1""")
def rebuild_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return SC.rebuild_concepts(M.chunks(spark, sf).withColumnRenamed("fl_created_at", "created_at"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_chunks").where("body is not null").select(F.concat_ws("/", "fl_source_file", "fl_id").alias("path"), code_key("fl_language").alias("language"), F.col("body").alias("text"))


@query()
def extract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return CODE.extract_symbols(_sources(spark, sf))


@query()
def extract_calls(spark: SparkSession, sf: str) -> DataFrame:
    return CODE.extract_calls(_sources(spark, sf))


def _run_stream(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """Everything that is there now, through the stream, into a table."""
    root = f"{Scratch(spark).root}/stream-{name}"
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/events.parquet*")
    kinds = {"view": "ask", "click": "show", "purchase": "recall", "signup": "open_narrative", "error": "close_narrative"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    return raw.select("event_id", F.col("user_id").alias("result_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("at"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_stream(spark, sf)
    twice = e.unionByName(e)
    return _run_stream(spark, ST.deduplicated(twice, delay="60 days").select("event_id"), "dedupe")


@query(with_("ev") + " SELECT a.event_id AS ask_id, f.event_id AS follow_id FROM ev a JOIN ev f ON a.result_id = f.result_id WHERE a.event_type = 'ask' AND f.event_type IN ('recall', 'show', 'trail', 'open_narrative') AND f.tm >= a.tm AND f.tm <= a.tm + INTERVAL 600 SECOND")
def stream_followups(spark: SparkSession, sf: str) -> DataFrame:
    return _run_stream(spark, ST.follow_up_stream(_event_stream(spark, sf), "60 days"), "followups").select("ask_id", "follow_id")
