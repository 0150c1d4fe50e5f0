"""Chunk files, embedding sidecars and file discovery as distributed reads and writes (SC2-SC7, SC10, SC14, SK1, SK2).

A chunk file is text with a front matter between lines of three hyphens. Front matter is read by a small
reader of flat YAML (scalars, and lists in brackets or of hyphens), which is what chunk writers make; it needs no library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, folders that are skipped, extensions of texts.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".ex": "elixir", ".exs": "elixir"}
SKIPPED = ("node_modules", ".git", "dist", "build", "__pycache__", "target", "vendor", ".next", ".nuxt", "coverage", ".turbo", ".cache")
TEXTS = (".md", ".mdx", ".txt", ".rst", ".yaml", ".yml", ".json", ".toml", ".adoc")


def _scalar(text: str) -> object:
    t = text.strip()
    if t in ("", "null", "~"):
        return None
    if t[:1] in "'\"" and t[-1:] == t[:1] and len(t) > 1:
        return json.loads(t) if t[0] == '"' else t[1:-1].replace("''", "'")
    if t[:1] == "[" and t[-1:] == "]":
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    return t


def parse_chunk(raw: str) -> tuple[dict[str, object], str]:
    """SC4: the front matter and the trimmed content; without front matter all is content."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", raw, re.S)
    if not m:
        return {}, raw.strip()
    fields: dict[str, object] = {}
    last = ""
    for line in m.group(1).splitlines():
        if (item := re.match(r"\s*-\s+(.*)", line)) and last:
            fields[last] = [*(fields[last] if isinstance(fields[last], list) else []), _scalar(item.group(1))]
        elif pair := re.match(r"([\w.-]+):(?:\s+(.*))?$", line):
            last = pair.group(1)
            fields[last] = _scalar(pair.group(2) or "")
    return fields, raw[m.end() :].strip()


def render_chunk(fields: dict[str, object], content: str) -> str:
    """SK1: the text of a chunk file; parse_chunk() gives fields and content back."""
    show = lambda v: "null" if v is None else "[" + ", ".join(json.dumps(str(x), ensure_ascii=False) for x in v) + "]" if isinstance(v, list) else json.dumps(str(v), ensure_ascii=False)
    return "---\n" + "".join(f"{k}: {show(v)}\n" for k, v in fields.items()) + "---\n" + content + "\n"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SC4, SC5: path, fl_type, fl_id, fields (map of text), content of every .md file below path."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_chunk(r) for r in b["raw"]]
            text = [{k: None if v is None else json.dumps(v) if isinstance(v, list) else str(v) for k, v in f.items()} for f, _ in parsed]
            yield pd.DataFrame({"path": b["path"], "fl_id": [t.get("fl_id") for t in text], "fl_type": [t.get("fl_type") for t in text], "fields": text, "content": [c for _, c in parsed]})

    return files.mapInPandas(run, "path string, fl_id string, fl_type string, fields map<string,string>, content string")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """SK1: chunks (fl_type and more) as Parquet, one folder a type."""
    chunks.write.mode("overwrite").partitionBy("fl_type").parquet(path)


def pack_embedding(model: str, vector: np.ndarray) -> bytes:
    """SC6: length of the header (two bytes, little endian), a JSON header, the vector as float32."""
    head = json.dumps({"model": model, "dim": len(vector)}).encode()
    return len(head).to_bytes(2, "little") + head + np.asarray(vector, "<f4").tobytes()


def unpack_embedding(data: bytes | None) -> tuple[str, list[float]] | None:
    """SC6: model and vector; None of anything cut short."""
    if data is None or len(data) < 2:
        return None
    n = int.from_bytes(data[:2], "little")
    if len(data) < 2 + n:
        return None
    head = json.loads(data[2 : 2 + n])
    end = 2 + n + 4 * head["dim"]
    return None if len(data) < end else (head["model"], np.frombuffer(data[2 + n : end], "<f4").tolist())


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """SC6: path, model, embedding of every .emb file below path; broken ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.emb").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *x) for p, c in zip(b["path"], b["content"]) if (x := unpack_embedding(c))]
            yield pd.DataFrame(out, columns=["path", "model", "embedding"])

    return files.mapInPandas(run, "path string, model string, embedding array<float>")


def discover(spark: SparkSession, path: str, texts: bool = False, force: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """SC2, SC3: path, language, size, digest of the source (or text) files below path.

    Skipped folders and paths that match a regular expression of ignore are left out, unless one of force matches.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    wanted = ext.isin(*TEXTS) if texts else names[ext].isNotNull()
    skip = F.col("path").rlike("/(" + "|".join(map(re.escape, SKIPPED)) + ")/")
    for p in ignore:
        skip = skip | F.col("path").rlike(p)
    for p in force:
        skip = skip & ~F.col("path").rlike(p)
    return df.where(wanted & ~skip).select("path", (F.lit("text") if texts else names[ext]).alias("language"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def rebuild_concepts(chunks: DataFrame) -> DataFrame:
    """SC14: concept_id, active_chunk_id, n_versions of chunks (id, concept_id, supersedes_id, created_at): the newest that nothing supersedes, else the newest."""
    gone = chunks.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"), F.lit(True).alias("gone")).distinct()
    c = chunks.where("concept_id is not null").join(gone, "id", "left")
    return c.groupBy("concept_id").agg(F.max(F.struct(F.col("gone").isNull().alias("live"), F.col("created_at"), F.col("id"))).alias("m"), F.count("*").alias("n_versions")).select("concept_id", F.col("m.id").alias("active_chunk_id"), "n_versions")
