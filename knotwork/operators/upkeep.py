"""Upkeep of a graph of concepts: grounding, names of clusters, discovery, health listings, reports, healing (AG8, AG12, GR13, GR14, HS3, HS13, HS15, HS17, HS18, HS20, JN6, JN15, QU6, RT3, SF23, SG5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import cosine_distance
from knotwork.operators.graph import both_ways, medoids
from knotwork.operators.health import heal, phase

# Share of a cluster's names that a common word is in, words of a name, least mean similarity of an edge.
COMMON, NAME_WORDS, EDGE_ABOVE = 0.4, 3, 0.1
# Least staleness that is healed, how many at once, and the growth of debt that stops it; debts of a manifest.
HEAL_FROM, HEAL_MOST, STOP_LOSS, CRITICAL_DEBT, DEGRADING_DEBT = 0.6, 5, 0.1, 25, 10


def weighted_centroids(vectors: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """AG12: the weighted mean vector of each group; where all weights are 0 the plain mean. Null weights are 0; partial sums keep hot groups small."""
    w, x = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.col("x").cast("double")
    e = vectors.select(group, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = e.groupBy(group, "i").agg(F.sum(x * F.col("w")).alias("s"), F.sum("w").alias("t"), F.avg(x).alias("m"))
    mean = F.when(F.col("t") == 0, F.col("m")).otherwise(F.col("s") / F.col("t"))
    return sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", mean.alias("x")))), lambda s: s["x"]).alias("centroid"))


def ground_residuals(concepts: DataFrame, code_of_concepts: DataFrame, text_of_concepts: DataFrame, symbols: DataFrame) -> DataFrame:
    """HS3: id, ground_residual, basis of concepts (id, churn): how far a concept is from the trusted mean of its symbols.

    code_of_concepts, text_of_concepts: id, vec. symbols: id (of the concept), confidence, code, text (vectors or null). First
    in the space of code; else in that of text; else the churn.
    """
    out = concepts.select("id", "churn")
    for kind, vecs in (("code", code_of_concepts), ("text", text_of_concepts)):
        mean = weighted_centroids(symbols.where(F.col(kind).isNotNull()), "id", kind, "confidence").withColumnRenamed("centroid", f"{kind}_mean")
        both = vecs.join(mean, "id").select("id", cosine_distance("vec", f"{kind}_mean").alias(f"{kind}_distance"))
        out = out.join(both, "id", "left")
    value = F.coalesce("code_distance", "text_distance", "churn")
    basis = F.when(F.col("code_distance").isNotNull(), "code").when(F.col("text_distance").isNotNull(), "text").otherwise("churn")
    return out.select("id", value.alias("ground_residual"), basis.alias("basis"))


def symbol_vector_search(symbol_vectors: DataFrame, bindings: DataFrame, concepts: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """JN6, RT3: chunk_id, distance: of the symbols nearest to the one row query (q), through their bindings to each concept's active chunk, the least.

    symbol_vectors: symbol_id, vec; bindings: concept_id, symbol_id; concepts: concept_id, active_chunk_id.
    """
    d = symbol_vectors.join(F.broadcast(query)).select("symbol_id", cosine_distance("vec", "q").alias("distance"))  # one row
    j = d.join(bindings.select("concept_id", "symbol_id"), "symbol_id").join(concepts.where("active_chunk_id is not null").select("concept_id", "active_chunk_id"), "concept_id")
    return j.groupBy(F.col("active_chunk_id").alias("chunk_id")).agg(F.min("distance").alias("distance")).orderBy(F.round("distance", 9), "chunk_id").limit(k)


def name_words(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.array_distinct(F.filter(F.split(c, r"[-_\s]+"), lambda w: F.length(w) > 2))


def cluster_names(members: DataFrame, cluster: str, name: str) -> DataFrame:
    """SF23: cluster, n, domain: the words that at least two fifths of its names have, the most frequent first, ties by word; 'mixed' if there is none."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("n"))
    words = members.select(cluster, F.explode(name_words(name)).alias("word")).groupBy(cluster, "word").agg(F.count("*").alias("m"))
    w = Window.partitionBy(cluster).orderBy(F.desc("m"), "word")
    top = words.join(sizes, cluster).where(F.col("m") >= F.ceil(COMMON * F.col("n"))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= NAME_WORDS)
    top = top.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda s: s["word"]), ", ").alias("domain"))  # three a cluster
    return sizes.join(top, cluster, "left").withColumn("domain", F.coalesce("domain", F.lit("mixed")))


def discovered(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """GR13: cluster, name, active_chunk_id, n_chunks of the concepts to be made: clusters that hold no concept's active chunk.

    chunks: chunk_id, cluster, title, vec; owners: active_chunk_id. The active chunk is the one nearest to the centroid; the
    name is that of the cluster's common words, or its number.
    """
    owned = chunks.join(owners.select(F.col("active_chunk_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select("cluster").distinct()
    orphans = chunks.where("cluster is not null").join(owned, "cluster", "left_anti")
    names = cluster_names(orphans, "cluster", "title")
    m = medoids(orphans, "chunk_id", "cluster", "vec")
    name = F.when(F.col("domain") == "mixed", F.concat(F.lit("cluster-"), F.col("cluster").cast("string"))).otherwise(F.regexp_replace("domain", ", ", "-"))
    return names.join(m, "cluster").select("cluster", name.alias("name"), F.col("medoid").alias("active_chunk_id"), F.col("n").alias("n_chunks"))


def cluster_edges(chunks: DataFrame, above: float = EDGE_ABOVE) -> DataFrame:
    """GR12, GR13: a, b, alpha of clusters whose members' mean cosine is above a limit.

    The mean cosine of two clusters is the product of their mean unit vectors, so no pairs of members are made; there
    is a row for each pair of clusters (cluster, vec).
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    u = chunks.where("cluster is not null").withColumn("u", F.transform("vec", lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))
    e = u.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    a, b = e.select(F.col("cluster").alias("a"), "i", F.col("x").alias("xa")), e.select(F.col("cluster").alias("b"), "i", F.col("x").alias("xb"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("alpha")).where(F.col("alpha") > above)


def edges_of_latest(edges: DataFrame, version: str) -> DataFrame:
    """GR14: the edges of the greatest graph version; none without a version."""
    last = edges.agg(F.max(version).alias("__v"))
    return edges.join(F.broadcast(last), F.col(version) == F.col("__v")).drop("__v")  # one row


def latest_run(signals: DataFrame) -> DataFrame:
    """AG8: run, created_at of the run that was made last (its greatest created_at), ties by the greater run; one row or none."""
    return signals.groupBy("run").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), F.desc("run")).limit(1)


def latest_signals(signals: DataFrame, concepts: DataFrame, k: int | None = None) -> DataFrame:
    """JN15: the signals (id, run, created_at, final_stale, residual_after) of the latest run with the name of concepts that still are (id, name), the stalest first."""
    one = F.broadcast(latest_run(signals).select("run"))  # one row
    out = signals.join(one, "run", "left_semi").join(concepts.select("id", "name"), "id")
    return out.orderBy(F.desc(F.round("final_stale", 9)), "name", "id").limit(k) if k else out


def health_neighbors(relations: DataFrame, concepts: DataFrame, final: DataFrame) -> DataFrame:
    """HS13: id, concept, direction, weight, final_stale, pos: the active relations of each concept from its own side, the heaviest first, then by name.

    relations: from_id, to_id, weight, active; a relation with itself is outbound. Ends that are no concepts (id, name) are left out;
    final: id, final_stale, null where it is not known.
    """
    r = relations.where("active = 1")
    out = r.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit("outbound").alias("direction"), "weight")
    into = r.where("from_id <> to_id").select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit("inbound").alias("direction"), "weight")
    j = out.unionByName(into).join(concepts.select(F.col("id").alias("other"), F.col("name").alias("concept")), "other").join(final.select(F.col("id").alias("other"), "final_stale"), "other", "left")
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "concept", "direction")
    return j.select("id", "concept", "direction", "weight", "final_stale", F.row_number().over(w).alias("pos"))


def explained(signals: DataFrame, relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """HS13: each concept's signals with the number of its neighbours, their mean weight and the heaviest one's name."""
    n = health_neighbors(relations, concepts, signals).groupBy("id").agg(F.count("*").alias("n_neighbors"), F.avg("weight").alias("mean_weight"), F.min(F.when(F.col("pos") == 1, F.col("concept"))).alias("heaviest"))
    return signals.join(n, "id", "left").withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)))


def heal_run(concepts: DataFrame, debt: float, fiedler: float, least: float = HEAL_FROM, most: int = HEAL_MOST, stop: float = STOP_LOSS) -> DataFrame:
    """HS15: the repairs of a run in order: id, staleness and residual before and after, debt_after, status.

    concepts: id, staleness, residual, final_stale. The stalest first, of equal ones the smaller id, at most `most` of those with at
    least `least`. Each repair changes the debt by its residual's change over 1 + fiedler; after one that lets it grow by more than
    stop, the rest are halted.
    """
    w = Window.orderBy(F.desc("final_stale"), "id")
    todo = concepts.where(F.col("final_stale") >= least).orderBy(F.desc("final_stale"), "id").limit(most)  # a handful of rows
    s, r = heal(F.coalesce("staleness", F.lit(0.0)), F.coalesce("residual", F.lit(0.0)), F.col("final_stale"))
    todo = todo.withColumn("staleness_after", s).withColumn("residual_after", r).withColumn("change", (F.col("residual_after") - F.coalesce("residual", F.lit(0.0))) / (1 + fiedler))
    bad = F.max(F.col("change") > stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    todo = todo.withColumn("status", F.when(F.coalesce(bad, F.lit(False)), "halted").otherwise("healed"))
    done = F.sum(F.when(F.col("status") == "healed", F.col("change")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return todo.select("id", "staleness", "residual", "final_stale", "staleness_after", "residual_after", (F.lit(debt) + done).alias("debt_after"), "status", F.row_number().over(w).alias("pos"))


def phase_transitions(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """HS17: narrative, id, distance, phase: how far the mean of a narrative's vectors lies from each concept that it wrote about.

    chunks: narrative, id (of the concept), vec; concepts: id, vec (of the active chunk). Distances under the first band are left out.
    """
    c = weighted_centroids(chunks.withColumn("__w", F.lit(1.0)), "narrative", "vec", "__w")
    pairs = chunks.select("narrative", "id").distinct()
    j = pairs.join(c, "narrative").join(concepts.select("id", "vec"), "id").withColumn("distance", cosine_distance("vec", "centroid"))
    return j.select("narrative", "id", "distance", phase(F.round("distance", 9)).alias("phase")).where("phase <> 'none'")


def manifest_health(manifest: DataFrame) -> DataFrame:
    """HS20: the band of a manifest's debt alone."""
    return manifest.withColumn("health", F.when(F.col("debt") >= CRITICAL_DEBT, "critical").when(F.col("debt") >= DEGRADING_DEBT, "degrading").otherwise("healthy"))


def status_report(*parts: DataFrame) -> DataFrame:
    """HS18, SG5: section, item, value: figures of one row each, written below each other. parts: one row of numbers with a column section."""
    rows = []
    for p in parts:
        names = [c for c in p.columns if c != "section"]
        rows.append(p.select("section", F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in names]))))
    return reduce(DataFrame.unionByName, rows)


def needs_refresh(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    """QU6: one row, refresh: the graph is stale (manifest: graph_stale) and no job is queued or leased (jobs: status)."""
    pending = jobs.agg(F.count_if(F.col("status").isin("queued", "leased")).alias("pending"))
    stale = manifest.agg(F.coalesce(F.max(F.col("graph_stale") == 1), F.lit(False)).alias("stale"))
    return stale.join(pending).select((F.col("stale") & (F.col("pending") == 0)).alias("refresh"), "pending")  # one row each


def peers(concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """RT15: id, cluster, n_peers, domain, n_relations of each concept (id, name, cluster): what its neighbourhood is about."""
    names = cluster_names(concepts.where("cluster is not null"), "cluster", "name")
    n = both_ways(relations).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n_relations"))
    out = concepts.join(names, "cluster").join(n, "id", "left")
    return out.select("id", "cluster", (F.col("n") - 1).alias("n_peers"), "domain", F.coalesce("n_relations", F.lit(0)).alias("n_relations"))
