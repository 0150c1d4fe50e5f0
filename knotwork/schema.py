"""Schemas of the logical tables and their audit (data model, LC16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXT = {
    "manifest": "version_id string, concept_graph_version string, fiedler_value double, debt double, debt_trend string, chunk_count long, concept_count long, last_integrated timestamp_ntz, last_embedded timestamp_ntz, inserted_at timestamp_ntz, graph_stale int, seq long",
    "concepts": "seq long, version_id string, id string, name string, active_chunk_id string, residual double, staleness double, cluster_id int, is_hub int, inserted_at timestamp_ntz, lifecycle_status string, archived_at timestamp_ntz, lifecycle_reason string, merged_into_concept_id string, churn double, ground_residual double, lore_residual double",
    "narratives": "seq long, version_id string, id string, name string, intent string, status string, theta double, magnitude double, convergence double, entry_count int, merge_base_commit_id string, opened_at timestamp_ntz, closed_at timestamp_ntz, inserted_at timestamp_ntz, targets array<struct<op: string, concept: string, from: string, to: string, source: string, into: string, reason: string, parts: array<string>>>",
    "chunks": "id string, file_path string, fl_type string, concept_id string, narrative_id string, supersedes_id string, status string, topics array<string>, convergence double, theta double, magnitude double, created_at timestamp_ntz, source_file_path string, concept_refs array<string>, symbol_refs array<string>, file_refs array<struct<path: string, lines: array<int>>>, concept_designations array<string>, content string",
    "embeddings": "id string, chunk_id string, embedding array<float>, model string, embedded_at timestamp_ntz",
    "symbols": "id string, source_file_id string, name string, qualified_name string, kind string, parent_id string, line_start int, line_end int, signature string, body_hash string, export_status string, scanned_at timestamp_ntz, removed_at timestamp_ntz",
    "source_files": "id string, file_path string, language string, content_hash string, size_bytes long, symbol_count int, scanned_at timestamp_ntz",
    "concept_symbols": "id string, concept_id string, symbol_id string, binding_type string, bound_body_hash string, confidence double, created_at timestamp_ntz, updated_at timestamp_ntz, bound_body string",
    "relations": "from_id string, to_id string, relation_type string, weight double, active int, updated_at timestamp_ntz",
    "commits": "id string, narrative_id string, parent_id string, merge_base_id string, message string, committed_at timestamp_ntz",
    "commit_tree": "commit_id string, concept_id string, chunk_id string, concept_name string",
    "interaction_events": "id string, result_id string, event_type string, subject string, meta_json string, created_at timestamp_ntz",
    "jobs": "id string, scope string, status string, owner string, attempt int, lease_expires_at timestamp_ntz, last_error string, payload_json string, result_json string, created_at timestamp_ntz, updated_at timestamp_ntz",
}


class _Schemas(dict):
    """Schemas by table, read from their text when they are first wanted, for which a session must be there."""

    def __missing__(self, name: str) -> T.StructType:
        self[name] = T.StructType.fromDDL(_TEXT[name])
        return self[name]


SCHEMAS: dict[str, T.StructType] = _Schemas()


def audit(df: DataFrame, name: str) -> list[tuple[str, str, str, str]]:
    """LC16: (column, finding, wanted, found): missing, extra or of another type; nothing if the table is as it should be."""
    want, have = {f.name: f.dataType.simpleString() for f in SCHEMAS[name]}, dict(df.dtypes)
    out = [(c, "missing", t, "") for c, t in want.items() if c not in have] + [(c, "extra", "", t) for c, t in have.items() if c not in want]
    return sorted(out + [(c, "type", t, have[c]) for c, t in want.items() if c in have and have[c] != t])


def repaired(df: DataFrame, name: str) -> DataFrame:
    """LC16: the table with all columns of its schema, missing ones null, types cast; extra ones are left out."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
