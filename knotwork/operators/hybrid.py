"""Search over all kinds of chunks: six lanes, their fusion, and results with content, warnings and next actions (RT7, RT8, RT15, RT20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import cosine_distance
from knotwork.operators.keywords import KeywordIndex, newest_first
from knotwork.operators.retrieval import keyword_distance

# How many candidates a lane has, the characters of a document that are shown, the limit of both warnings, and their texts.
LANE, DOC_CHARS, WARN_ABOVE, BODIES = 20, 4_000, 0.5, 5
RESIDUAL_WARNING, STALE_WARNING = "high residual — verify against code", "content may be stale"


def vector_lane(vectors: DataFrame, query: DataFrame, fl_type: str, k: int = LANE) -> DataFrame:
    """The k chunks of a type nearest to the one row query (q): id, distance, pos. vectors: id, fl_type, created_at, vec."""
    near = vectors.where(F.col("fl_type") == fl_type).join(F.broadcast(query)).select("id", "created_at", F.round(cosine_distance("vec", "q"), 6).alias("distance"))  # one row
    if fl_type != "chunk":  # recency breaks ties in all lanes but this
        return newest_first(near, F.col("distance"), "created_at", "id", k).select("id", "distance", "pos")
    return newest_first(near.withColumn("created_at", F.lit(None).cast("timestamp_ntz")), F.col("distance"), "created_at", "id", k).select("id", "distance", "pos")


def keyword_lane(index: KeywordIndex, terms: list[str], fl_type: str, k: int = LANE) -> DataFrame:
    """The k chunks of a type with the best keyword rank, the distance being that of their place."""
    found = index.search(terms, "fl_type", "created_at").where(F.col("fl_type") == fl_type).withColumn("rank", F.round("rank", 6))
    return newest_first(found, F.col("rank"), "created_at", index.key, k).select(F.col(index.key).alias("id"), keyword_distance(F.col("pos")).alias("distance"), "pos")


def lanes(index: KeywordIndex, terms: list[str], vectors: DataFrame, text_query: DataFrame, code_vectors: DataFrame, code_query: DataFrame | None, mode: str | None = None, kind: str = "chunk", k: int = LANE) -> dict[str, DataFrame]:
    """RT7: the lanes of a question. kind 'journal' has the text lane and, with a code query, the code lane only; mode 'arch' has no code lane."""
    out = {"text_vector": vector_lane(vectors, text_query, kind, k)}
    if code_query is not None and mode != "arch":
        out["code_vector"] = vector_lane(code_vectors, code_query, "source", k)
    if kind == "chunk":
        out |= {f"bm25_{t}": keyword_lane(index, terms, t, k) for t in ("source", "chunk", "doc")}
        out["doc_vector"] = vector_lane(vectors, text_query, "doc", k)
    return out


def fused(found: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """id, distance, score, lane, pos: the least distance of each chunk over the lanes, the first limit of them; ties by id."""
    rows = reduce(DataFrame.unionByName, [d.select("id", "distance", F.lit(name).alias("lane")) for name, d in found.items()])
    best = rows.groupBy("id").agg(F.min(F.struct("distance", "lane")).alias("b")).select("id", "b.*").withColumn("score", 1 - F.col("distance"))  # at most six times k rows
    w = Window.orderBy("distance", "id")
    best = best.withColumn("pos", F.row_number().over(w) - 1)
    return best.where(F.col("pos") < limit) if limit else best


def lane_counts(found: dict[str, DataFrame]) -> DataFrame:
    """The number of candidates of each lane, and of all chunks together."""
    one = [d.agg(F.count("*").alias("candidates")).select(F.lit(n).alias("lane"), "candidates") for n, d in found.items()]
    return reduce(DataFrame.unionByName, [*one, fused(found).agg(F.count("*").alias("candidates")).select(F.lit("fused").alias("lane"), "candidates")])


def symbol_bodies(concepts: DataFrame, bindings: DataFrame, symbols: DataFrame, files: DataFrame, most: int = BODIES) -> DataFrame:
    """concept_id, bodies: the blocks of its most trusted symbols; those without a body are left out, but count among the most.

    bindings: concept_id, symbol_id, confidence; symbols: symbol_id, source_file_id, qualified_name, line_start, line_end, body;
    files: source_file_id, file_path, language. Bindings of other concepts than those given are not looked at.
    """
    b = bindings.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi")
    b = b.join(symbols, "symbol_id").join(files, "source_file_id")
    w = Window.partitionBy("concept_id").orderBy(F.desc("confidence"), "symbol_id")
    b = b.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    block = F.format_string("\n\n[Symbol: %s (%s:%s-%s)]\n```%s\n%s\n```", "qualified_name", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), "language", "body")
    b = b.where("body is not null and body <> ''").groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("rn", block.alias("b")))).alias("l"))  # at most five a concept
    return b.select("concept_id", F.array_join("l.b", "").alias("bodies"))


def hydrated(results: DataFrame, chunks: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """RT8: results with concept, content and warning; chunks that don't exist are left out.

    chunks: id, fl_type, title (symbol, path or concept), concept_id, content, path, line_start, line_end, language,
    residual, staleness. A source gets its place and a fence, a document its path and its first characters, a
    state chunk the bodies of its symbols. Staleness overrides residual in the warning.
    """
    j = results.join(chunks, "id")
    j = j.join(bodies, "concept_id", "left") if bodies is not None else j.withColumn("bodies", F.lit(None).cast("string"))
    body, text = F.coalesce("content", F.lit("")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = F.concat(F.lit("[Source: "), text("path"), F.lit(":"), text("line_start"), F.lit("-"), text("line_end"), F.lit("]\n```"), text("language"), F.lit("\n"), body, F.lit("\n```"))
    doc = F.concat(F.lit("[Doc: "), text("path"), F.lit("]\n"), F.substring(body, 1, DOC_CHARS))
    state = F.concat(body, F.coalesce("bodies", F.lit("")))
    kind = F.col("fl_type")
    warning = F.when(~kind.isin("source", "doc"), F.when(F.col("staleness") > WARN_ABOVE, STALE_WARNING).when(F.col("residual") > WARN_ABOVE, RESIDUAL_WARNING))
    content = F.when(kind == "source", source).when(kind == "doc", doc).otherwise(state)
    return j.select("pos", "id", "fl_type", "score", F.col("title").alias("concept"), content.alias("content"), warning.alias("warning"), "staleness")


def stale_signals(results: DataFrame, drifted: Column | None = None, claims: DataFrame | None = None) -> DataFrame:
    """RT20: one row, stale: whether a result has a warning, more than .4 staleness or drifted symbols, or a claim rests on such a source."""
    one = F.col("warning").isNotNull() | (F.coalesce("staleness", F.lit(0.0)) > 0.4)
    one = one | F.coalesce(drifted, F.lit(False)) if drifted is not None else one
    out = results.agg(F.coalesce(F.max(one), F.lit(False)).alias("stale"))
    if claims is not None:
        c = claims.agg(F.coalesce(F.max(F.coalesce("max_staleness", F.lit(0.0)) > 0.4), F.lit(False)).alias("of_claims"))
        out = out.join(c).select((F.col("stale") | F.col("of_claims")).alias("stale"))  # one row each
    return out


def next_actions(results: DataFrame, stale: DataFrame, trails: DataFrame) -> DataFrame:
    """RT20: place, kind, is_primary, target, reason of what to do next: show or ingest, recall, and trail if just one narrative has a trail.

    results: pos, concept; stale: one row; trails: narrative, a row for each that was found.
    """
    first = results.agg(F.min_by("concept", "pos").alias("concept"), F.count("*").alias("n"))
    row = first.join(stale).join(trails.agg(F.count("*").alias("n_trails"), F.min("narrative").alias("narrative")))  # one row each
    look = F.when(F.col("stale"), "Inspect the canonical concept before acting because this answer carries drift or staleness signals.").otherwise("Inspect the canonical concept before making a change.")
    some = F.col("n") > 0
    act = lambda place, kind, main, target, reason: F.struct(F.lit(place).alias("place"), kind.alias("kind"), F.lit(main).alias("is_primary"), target.alias("target"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    actions = F.array(
        act(1, F.when(some, "show").otherwise("ingest"), True, F.when(some, F.col("concept")), F.when(some, look).otherwise("No concept matched cleanly. Refresh the lake before trusting an empty answer.")),
        act(2, F.lit("recall"), False, none, F.lit("Expand the sources, file refs, and bindings behind this answer.")),
        act(3, F.when(F.col("n_trails") == 1, "trail"), False, F.col("narrative"), F.lit("Replay the strongest investigation trail behind this answer.")),
    )
    return row.select(F.inline(actions)).where("kind is not null")
