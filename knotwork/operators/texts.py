"""Procedural operators on single texts and ordered groups (SC16, SF22, WN8, LC10, LC14), in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.scratch import Scratch

# Size of a chunk in estimated tokens, overlap of lines, limits of a diff and of a merged span.
TARGET, OVERLAP, DIFF_LINES, GAP, REACH, MOST = 900, 0.15, 500, 8, 6, 14


def chunk_markdown(text: str, target: int = TARGET, overlap: float = OVERLAP) -> list[tuple[str, str, int]]:
    """SC16: (content, headings, tokens): sections between headings outside fences, packed up to target tokens.

    A part that would exceed it is closed first; its last lines are the next one's first. Without overlap lines
    nothing is kept (where a slice of minus zero would keep all).
    """
    lines, starts, fenced = text.split("\n"), [0], False
    for i, line in enumerate(lines):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and re.match(r"#{1,6}\s+.+", line) and i:
            starts.append(i)
    heads = {i: re.sub(r"^#{1,6}\s+", "", lines[i]).strip() for i in starts if re.match(r"#{1,6}\s+.+", lines[i])}
    size = lambda ls: -(-len("\n".join(ls)) // 4)
    out, part, titles = [], [], []

    def close() -> None:
        if body := "\n".join(part).strip():
            out.append((body, " > ".join(titles), -(-len(body) // 4)))

    for a, b in zip(starts, [*starts[1:], len(lines)]):
        section = lines[a:b]
        if part and size(part) + size(section) > target:
            close()
            keep = int(len(part) * overlap)
            part = part[len(part) - keep :] if keep else []
        part = [*part, *section]
        titles = [h for i, h in heads.items() if i <= a] or titles
    close()
    return out


def markdown_chunks(docs: DataFrame, key: str, text: str, target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """SC16: key, chunk, content, headings, tokens; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, *c) for k, t in b.itertuples(index=False) if t for i, c in enumerate(chunk_markdown(t, target, overlap))], columns=[key, "chunk", "content", "headings", "tokens"])

    rows = docs.select(key, text)
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, chunk int, content string, headings string, tokens int")


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int, str]]:
    """(op, old line, new line, text) of all lines along a longest common subsequence; among equal ways additions come last."""
    m, n = len(a), len(b)
    ids = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([ids[t] for t in a], np.int32), np.array([ids[t] for t in b], np.int32)
    best = np.zeros((m + 1, n + 1), np.int32)  # lengths of the subsequences of all beginnings, a row at a time
    for i in range(m):
        best[i + 1, 1:] = np.maximum.accumulate(np.where(y == x[i], best[i, :-1] + 1, best[i, 1:]))
    out, i, j = [], m, n
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            out.append(("same", i, j, a[i - 1]))
            i, j = i - 1, j - 1
        elif j and (not i or best[i, j - 1] >= best[i - 1, j]):
            out.append(("add", 0, j, b[j - 1]))
            j -= 1
        else:
            out.append(("remove", i, 0, a[i - 1]))
            i -= 1
    return out[::-1]


def hunks(script: list[tuple[str, int, int, str]], context: int = 3) -> list[list[tuple[str, int, int, str]]]:
    """The changes of a script with context lines around them; hunks that touch or overlap are one."""
    out: list[list[int]] = []
    for at in (i for i, line in enumerate(script) if line[0] != "same"):
        low, high = max(0, at - context), min(len(script), at + context + 1)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [script[low:high] for low, high in out]


def line_diff(old: str, new: str, context: int = 3, max_lines: int | None = DIFF_LINES) -> list[tuple[str, int, int, str]]:
    """SF22: the lines of all hunks; texts of more than max_lines lines give nothing, None compares texts of any length."""
    a, b = old.split("\n"), new.split("\n")
    if max_lines is not None and max(len(a), len(b)) > max_lines:
        return []
    return [line for h in hunks(edit_script(a, b), context) for line in h]


def line_diffs(pairs: DataFrame, key: str, context: int = 3, max_lines: int | None = DIFF_LINES) -> DataFrame:
    """SF22 over pairs (key, old, new): key, hunk (from 1), op, old_line, new_line, line; a null text is an empty one.

    A pair above max_lines has one row of op 'too-large' and hunk 0, so it is not taken for unchanged.
    """

    def rows_of(k: object, old: str, new: str) -> Iterator[tuple]:
        a, b = old.split("\n"), new.split("\n")
        if max_lines is not None and max(len(a), len(b)) > max_lines:
            yield k, 0, "too-large", len(a), len(b), None
            return
        for n, h in enumerate(hunks(edit_script(a, b), context)):
            yield from ((k, n + 1, *line) for line in h)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for k, o, n in b.itertuples(index=False) for r in rows_of(k, o or "", n or "")], columns=[key, "hunk", "op", "old_line", "new_line", "line"])

    rows = pairs.select(key, "old", "new")
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, hunk int, op string, old_line int, new_line int, line string")


def merge3(base: str, ours: str, theirs: str) -> tuple[str, int]:
    """LC9: a three-way merge by lines and the number of its conflicts: what one side changed is taken, what both changed alike once.

    Runs that both changed differently stay side by side between marks.
    """
    a, b, c = base.split("\n"), ours.split("\n"), theirs.split("\n")
    to_b = {i - 1: j - 1 for op, i, j, _ in edit_script(a, b) if op == "same"}
    to_c = {i - 1: j - 1 for op, i, j, _ in edit_script(a, c) if op == "same"}
    out, faults, i, j, k = [], 0, 0, 0, 0
    anchors = [n for n in range(len(a)) if n in to_b and n in to_c] + [len(a)]
    for n in anchors:
        jn, kn = (to_b[n], to_c[n]) if n < len(a) else (len(b), len(c))
        x, y, z = a[i:n], b[j:jn], c[k:kn]
        if y == z or z == x:
            out += y
        elif y == x:
            out += z
        else:
            faults += 1
            out += ["<<<<<<<", *y, "=======", *z, ">>>>>>>"]
        if n < len(a):
            out.append(a[n])
        i, j, k = n + 1, jn + 1, kn + 1
    return "\n".join(out), faults


def merged(versions: DataFrame, key: str) -> DataFrame:
    """LC9: key, content, conflicts of versions (key, base, ours, theirs); nulls are empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame([(k, *merge3(a or "", b or "", c or "")) for k, a, b, c in f.itertuples(index=False)], columns=[key, "content", "conflicts"])

    rows = versions.select(key, "base", "ours", "theirs")
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, content string, conflicts int")


def coalesce_spans(lines: list[int]) -> list[tuple[int, int, int]]:
    """WN8: (first, last, number) of sorted sites: one within GAP lines of a span's end joins it; a span reaches at most MOST lines."""
    out: list[list[int]] = []
    for line in lines:
        if out and line - out[-1][1] <= GAP:
            out[-1][1] = min(line + REACH, out[-1][0] + MOST)
            out[-1][2] += 1
        else:
            out.append([line, line + REACH, 1])
    return [tuple(x) for x in out]


def coalesced_sites(sites: DataFrame) -> DataFrame:
    """WN8: caller, file, first_line, last_line, sites of call sites (caller, file, line).

    The limit depends on the running span, so it is no window; a gap of more than GAP plus MOST lines always
    parts spans, so sites are first cut there and only short runs are gathered.
    """
    w = Window.partitionBy("caller", "file").orderBy("line")
    cut = (F.col("line") - F.lag("line").over(w) > GAP + MOST + REACH).cast("int")
    runs = sites.select("caller", "file", "line").distinct().withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("run", F.sum("cut").over(w))
    grouped = runs.groupBy("caller", "file", "run").agg(F.array_sort(F.collect_list("line")).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(c, f, *s) for c, f, ls in b.itertuples(index=False) for s in coalesce_spans([int(x) for x in ls])], columns=["caller", "file", "first_line", "last_line", "sites"])

    kinds = {x.name: x.dataType.simpleString() for x in sites.schema}
    return grouped.select("caller", "file", "lines").mapInPandas(run, f"caller {kinds['caller']}, file {kinds['file']}, first_line int, last_line int, sites int")


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, least: int = 3) -> DataFrame:
    """LC14, JN21: key, name_id, confidence .5: symbols whose name (of least letters) stands in a text as a word.

    The text's words meet the names in an equi-join, never a pattern for every pair. Ids that have the same set of names are one
    group; texts are made distinct by group, so the rows, of which there may be thousands a word, are neither shuffled nor sorted.
    """
    tmp = Scratch(texts.sparkSession)
    ids = tmp.cut(names.where(F.length("name") >= least).groupBy("name_id").agg(F.array_sort(F.collect_set("name")).alias("names")))
    groups = tmp.cut(ids.select("names").distinct().select("names", F.monotonically_increasing_id().alias("group")))  # written once, so the numbers stay the same
    named = tmp.cut(groups.select("group", F.explode("names").alias("name")))  # so that a small table is known to be small before texts are read
    members = ids.join(groups, "names").select("group", "name_id")
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z0-9_]+"))).alias("name"))
    found = words.where(F.length("name") >= least).join(named, "name").select(key, "group").distinct()
    return found.join(members, "group").select(key, "name_id", F.lit(0.5).alias("confidence"))


def file_overlap(bindings: DataFrame, symbols: DataFrame, confidence: float = 0.8) -> DataFrame:
    """LC14: concept_id, symbol_id of unbound symbols in files that a concept is already bound to."""
    s = symbols.select(F.col("id").alias("symbol_id"), "source_file_id")
    bound = bindings.select("concept_id", "symbol_id").distinct()
    near = bound.join(s, "symbol_id").select("concept_id", "source_file_id").distinct().join(s, "source_file_id").select("concept_id", "symbol_id")
    return near.join(bound, ["concept_id", "symbol_id"], "left_anti").withColumn("confidence", F.lit(confidence))


def block_overlap(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """LC10, ST4: of each block (block_id, grp, text) the words it shares with the entries (grp, text) of its group."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) > 2))
    e = entries.select("grp", F.explode(words("text")).alias("word")).distinct()
    b = blocks.select("block_id", "grp", F.explode(words("text")).alias("word"))
    return b.join(e, ["grp", "word"]).groupBy("block_id", "grp").agg(F.count("*").alias("shared"))
