"""Splitting oversized items at natural boundaries, by content.

A gear hash rolls over the last 32 characters; where its low bits are zero lies a landmark. After a cut
the next one is sought between the least and the greatest size: the first landmark there is moved to the
nearest natural boundary of the best kind that the window holds. Cuts depend on the text near them and
on the cut before, so after an edit they soon fall on the old places again.

Cuts divide the text; a piece is the text from overlap characters before its cut to the next cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WINDOW = 32
_GEAR = np.random.default_rng(20_240_601).integers(0, 1 << 32, 1 << 16, dtype=np.uint64)
_LINE = re.compile(r"\r\n|\r|\n")
#: Kinds of boundaries from weak to strong, each a pattern whose match ends (or, last, begins) at the boundary.
_WORD = re.compile(r"\s+|[，、；：]")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？।॥؟。！？][」』”’）]*")
_BLANK = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+")
_BLOCK = re.compile(r"^(?=#{1,6} |```|(?:export |pub |async |static |default )*(?:def|defp|defmodule|class|func|function|fn|impl|struct|interface|enum|trait|type|module)\b)", re.M)


def landmarks(text: str, bits: int) -> np.ndarray:
    """Places (before the character of that index) at which the rolling hash has bits zero bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    g = _GEAR[codes & 0xFFFF] ^ (codes >> 16).astype(np.uint64)
    h = np.zeros(len(g), np.uint64)
    for k in range(min(_WINDOW, len(g))):
        h[k:] += g[: len(g) - k] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << bits) - 1) == 0) + 1


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted places of each kind, the strongest first."""
    ends = lambda p: np.array([m.end() for m in p.finditer(text)], np.int64)
    return [np.array([m.start() for m in _BLOCK.finditer(text)], np.int64), ends(_BLANK), ends(_LINE), ends(_SENTENCE), ends(_WORD)]


def _whole(text: str, at: int, low: int) -> int:
    """The place at or before at that divides no line end and no character from its marks."""
    k = at
    while k > low and k < len(text) and (text[k - 1] == "\r" and text[k] == "\n" or unicodedata.combining(text[k]) or unicodedata.category(text[k]) in ("Mn", "Mc", "Me") or text[k] in "‍️" or text[k - 1] == "‍"):
        k -= 1
    return k if k > low else at


def cuts(text: str, greatest: int, overlap: int) -> list[int]:
    """Places that divide text into new parts of pieces of at most greatest characters with overlap."""
    room = greatest - overlap
    least = max(1, room // 4)
    marks, kinds, out, at = landmarks(text, max(1, (room - least).bit_length() - 2)), boundaries(text), [], 0
    while len(text) - at > (room if at else greatest):
        low, high = at + least, at + (room if at else greatest)
        k = np.searchsorted(marks, low)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        for places in kinds:
            i, j = np.searchsorted(places, low), np.searchsorted(places, high, "right")
            if i < j:
                near = places[i:j]
                at = int(near[np.argmin(np.abs(near - mark))])
                break
        else:
            at = _whole(text, mark, low - 1)
        out.append(at)
    return out


def pieces(text: str, greatest: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one if it is not too long."""
    overlap = max(0, min(overlap, greatest // 2))
    ends = [*cuts(text, greatest, overlap), len(text)]
    return [(max(0, s - overlap), e) for s, e in zip([0, *ends], ends)]


def lines(text: str, spans: list[tuple[int, int]], first: int) -> list[tuple[int, int]]:
    """First and last line of each span; a line end is CR LF, CR or LF and belongs to the line it ends."""
    ends = np.array([m.end() for m in _LINE.finditer(text)], np.int64)
    return [(first + int(np.searchsorted(ends, s, "right")), first + int(np.searchsorted(ends, max(s, e - 1), "right"))) for s, e in spans]


def split_items(items: DataFrame) -> DataFrame:
    """The pieces of each item that has more than max_chars characters.

    items: item_table, item_id, content, first_line, max_chars, overlap_chars. Result: item_table, item_id,
    piece (from 0), start_char, end_char, line_start, line_end, overlap, body. Characters are code points of
    the stored text. Pieces without their overlaps are the text. Items of null content, null or non-positive
    limits, or no more than max_chars are left out; a null overlap is 0, one above half the limit is half; a
    null first_line is 1. Repeated rows give repeated pieces; other columns are ignored. Each item is split
    by itself, so no group is gathered; only oversized contents reach Python.
    """
    big = items.where((F.col("max_chars") > 0) & (F.length("content") > F.col("max_chars")))
    big = big.select("item_table", "item_id", "content", F.coalesce("first_line", F.lit(1)).alias("first_line"), "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, i, text, first, greatest, overlap in batch.itertuples(index=False):
                spans = pieces(text, greatest, overlap)
                before = 0
                for n, ((s, e), (a, b)) in enumerate(zip(spans, lines(text, spans, first))):
                    out.append((t, i, n, s, e, a, b, before - s if n else 0, text[s:e]))
                    before = e
            yield pd.DataFrame(out, columns=["item_table", "item_id", "piece", "start_char", "end_char", "line_start", "line_end", "overlap", "body"])

    return big.mapInPandas(run, "item_table string, item_id string, piece int, start_char int, end_char int, line_start int, line_end int, overlap int, body string")
