"""One object over a knowledge graph's tables: the calls a user of the engine makes, each a DataFrame.

Tables are those of schema.py, by name; tables that are missing are empty ones. now is a parameter of every
call that needs it. Writing calls return the rows to append; where they go is the caller's business, and
one writer a table is assumed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import coverage, graph, health, keywords, lifecycle, queues, retrieval, suggest, versioning, views
from knotwork.operators.interactions import scorecard as _scorecard
from knotwork.schema import SCHEMAS


class KnowledgeGraph:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self._tables = spark, tables

    def table(self, name: str) -> DataFrame:
        return self._tables[name] if name in self._tables else self.spark.createDataFrame([], SCHEMAS[name])

    def concepts(self, active: bool = True) -> DataFrame:
        now = views.latest(self.table("concepts"), "id", "seq")
        return now.where(views.is_active("lifecycle_status")) if active else now

    def ls(self) -> DataFrame:
        """Concepts by residual, then staleness, then name."""
        return self.concepts().select("name", "id", "residual", "staleness", "cluster_id").orderBy(F.round("residual", 9).desc_nulls_last(), F.round("staleness", 9).desc_nulls_last(), "name")

    def show(self, name: str) -> DataFrame:
        """The active chunk of the concept of that name, letter case ignored, the newest if there are several."""
        c = self.concepts(False).where(F.lower("name") == name.lower()).orderBy(F.desc("seq")).limit(1)
        return c.join(self.table("chunks").select(F.col("id").alias("active_chunk_id"), "content", "created_at"), "active_chunk_id", "left").select("id", "name", "active_chunk_id", "content", "created_at")

    def history(self, name: str) -> DataFrame:
        ids = self.concepts(False).where(F.lower("name") == name.lower()).select("id")
        return versioning.version_chain(self.table("concepts").join(ids, "id", "left_semi"), "id", "seq").select("id", "version", "version_id", "residual", "staleness", "inserted_at", "previous_version_id", "next_version_id")

    def ask(self, question: str, k: int = 20, query_vector: list[float] | None = None, model: str | None = None, fl_type: str | None = None) -> DataFrame:
        """RT7: keyword and vector lanes over the chunks that nothing supersedes, fused by distance, one row a concept."""
        chunks = self.table("chunks")
        live = views.not_superseded(chunks, "id", "supersedes_id").select("id", "concept_id", "fl_type")
        live = live.where(F.col("fl_type") == fl_type) if fl_type else live
        gone = self.concepts(False).where(~views.is_active("lifecycle_status")).select(F.col("id").alias("concept_id"))
        live = live.join(gone, "concept_id", "left_anti")
        terms = keywords.query_tokens(question + " " + re.sub("([A-Z])", r" \1", question))
        words = retrieval.bm25(chunks, "id", "content", terms).join(live.select("id"), "id", "left_semi")
        lanes = [retrieval.ranked(words, F.col("rank"), "id", k).withColumn("distance", retrieval.keyword_distance(F.col("pos")))]
        if query_vector is not None:
            e = self.table("embeddings")
            e = e.where(F.col("model") == model) if model else e
            lanes.append(retrieval.ranked(retrieval.vector_distances(e.select(F.col("chunk_id").alias("id"), "embedding").join(live.select("id"), "id", "left_semi"), "id", "embedding", query_vector), F.col("distance"), "id", k))
        merged = retrieval.merge_by_distance(lanes, "id").join(live, "id")
        placed = retrieval.ranked(merged, F.round("distance", 9), "id", 2 * k)
        return retrieval.best_per_concept(placed, "concept_id", "id").orderBy("slot", "id").limit(k).select("id", "concept_id", "fl_type", "score", "slot")

    def symbol_search(self, text: str, k: int = 20) -> DataFrame:
        """RT4."""
        s = self.table("symbols").select("id", "name", F.regexp_replace(F.concat_ws(" ", "name", "qualified_name", "signature"), "([A-Z])", " $1").alias("text"))
        terms = keywords.query_tokens(re.sub("([A-Z])", r" \1", text))
        return retrieval.top(retrieval.bm25(s, "id", "text", terms).join(s.select("id", "name"), "id"), F.col("rank"), "id", k)

    def coverage(self) -> DataFrame:
        return coverage.coverage_stats(self.table("concept_symbols"), self.table("symbols"), self.table("source_files"))

    def concept_coverage(self) -> DataFrame:
        return coverage.concept_coverage(self.table("concept_symbols"), self.table("symbols"), self.concepts())

    def bootstrap(self, imports: DataFrame | None = None) -> DataFrame:
        imports = imports if imports is not None else self.spark.createDataFrame([], "from_path string, to_path string")
        open_ = coverage.uncovered(self.table("concept_symbols"), self.table("symbols"), self.table("source_files"), True)
        return suggest.bootstrap_plan(open_, suggest.dependency_boost(imports))

    def drift(self) -> DataFrame:
        return coverage.drifted(self.table("concept_symbols"), self.table("symbols"), self.table("source_files"), self.concepts(False))

    def _scored(self) -> DataFrame:
        return self.concepts().join(coverage.drift_scores(self.drift()).select(F.col("concept_id").alias("id"), F.col("score").alias("drift")), "id", "left")

    def health(self, critical: list[str] | None = None, debt: float = 0.0, fiedler: float = 0.0) -> DataFrame:
        """HS12."""
        return health.health_signals(self._scored().withColumn("critical", F.col("id").isin(critical or [])), self.table("relations"), debt, fiedler)

    def status(self, fiedler: float = 0.0, persisted: float = 0.0) -> DataFrame:
        """HS8, HS10: one row of debt, hot staleness and priority pressure."""
        c = self._scored()
        one = health.live_debt(c, fiedler, persisted)
        for x in (health.hot_staleness(c), health.priority_pressure(c)):
            one = one.join(F.broadcast(x))  # one row each
        return one

    def suggestions(self, most: int = 20) -> DataFrame:
        c = self.concepts()
        related = graph.both_ways(self.table("relations")).select(F.col("node").alias("id")).distinct()
        drift = coverage.drift_scores(self.drift()).select(F.col("concept_id").alias("id"), "n_drifted")
        kinds = [suggest.symbol_drift(drift), suggest.review(c), suggest.cluster_drift(c), suggest.archive(c, related)]
        return suggest.put_together(kinds, ["symbol-drift", "review", "cluster-drift", "archive"], most)

    def relations(self) -> DataFrame:
        return graph.both_ways(self.table("relations"))

    def diff(self, before: str, after: str, now: Column) -> DataFrame:
        """LC5: the difference of the trees of two references."""
        commits, tree = self.table("commits"), self.table("commit_tree")
        at = lambda ref: tree.join(versioning.resolve_ref(commits, ref, now).select(F.col("id").alias("commit_id")), "commit_id", "left_semi").select(F.lit(0).alias("line"), "concept_id", "chunk_id")
        return versioning.tree_diff(at(before), at(after)).drop("line")

    def log(self, most: int = 50) -> DataFrame:
        return self.table("commits").orderBy(F.desc("committed_at"), F.desc("id")).limit(most)

    def open(self, requests: DataFrame) -> DataFrame:
        """LC7: the verdicts on the targets of narratives to be opened."""
        return lifecycle.check_targets(requests, self.concepts(False).select("name", F.col("lifecycle_status").alias("status")))

    def rename(self, concept_id: str, name: str, version_id: str, now: Column, seq: Column) -> DataFrame:
        """LC12: the next version of a concept, to be appended; seq: its place in the order of arrival of all rows."""
        c = self.concepts(False).where(F.col("id") == concept_id)
        return c.withColumn("name", F.lit(name)).withColumn("version_id", F.lit(version_id)).withColumn("inserted_at", now).withColumn("seq", seq)

    def jobs(self) -> DataFrame:
        return queues.counts(self.table("jobs"), ["scope"])

    def scorecard(self, events: DataFrame, scores: DataFrame) -> DataFrame:
        return _scorecard(events, scores)
