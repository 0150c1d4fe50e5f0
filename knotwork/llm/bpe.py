"""Byte-pair encoding of whole corpora with a public rank file.

Each piece of the pre-splitting pattern is merged with a segment tree over its byte positions: a leaf
holds the rank of the pair that begins there, an inner node the leftmost minimum below it, so the next
merge is read at the root. A merge changes the leaves of the position, of its dead right neighbour and of
its live left neighbour, each in logarithmic time. Short pieces, of which a corpus has few different
ones, are merged many at a time, one numpy row each; long pieces go through the same tree one by one.

The rank file's bytes are broadcast (about 1 MB, whatever the corpus); executors need no file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of Unicode. A run of other characters, with one blank before it, is always split for itself.
_WS = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_NONE = np.int64(1 << 60)
_VECTOR_BYTES = 256
#: Bytes of the pieces and units that a process keeps, and of one that is kept at all.
_CACHE_BYTES, _KEEP_BYTES = 96_000_000, 4_096
_BATCH_CHARS = 2_000_000


class Encoder:
    """Text to ids; keeps the ids of pieces it has met, up to a bound of memory."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = ranks.get(token[:i])
                b = ranks.get(token[i:]) if a is not None else None
                if b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.pairs = dict(zip(keys, values))
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.held = 0

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        want = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], -1)

    def _merge_one(self, data: bytes) -> bytes:
        """A long piece: the segment tree in plain integers."""
        n = len(data)
        size = 1 << max(1, (n - 1).bit_length())
        shift = size.bit_length()
        none, pairs = int(_NONE), self.pairs
        ids = [int(self.byte[b]) for b in data]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        mask = (1 << shift) - 1
        while (top := tree[1]) != none:
            i, rank = top & mask, top >> shift
            j = right[i]
            ids[i], nxt, before = rank, right[j], left[i]
            ids[j] = -1
            right[i] = nxt
            if nxt < n:
                left[nxt] = i
            for p, a, b in ((i, rank, ids[nxt] if nxt < n else None), (j, None, None), (before, ids[before] if before >= 0 else None, rank)):
                if p < 0:
                    continue
                r = pairs.get(a << 20 | b) if a is not None and b is not None else None
                k, v = size + p, none if r is None else r << shift | p
                tree[k] = v
                k >>= 1
                while k:
                    x, y = tree[2 * k], tree[2 * k + 1]
                    v = x if x < y else y
                    if tree[k] == v:
                        break
                    tree[k] = v
                    k >>= 1
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def _merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most size bytes (a power of two): one row of the tree each."""
        m, shift = len(pieces), size.bit_length()
        lengths = np.array([len(p) for p in pieces])
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((m, size + 1), -1, np.int64)
        ids[:, :size][np.arange(size) < lengths[:, None]] = flat
        right = np.tile(np.arange(1, size + 2), (m, 1))
        left = np.tile(np.arange(-1, size), (m, 1))
        tree = np.full((m, 2 * size), _NONE, np.int64)
        here = np.arange(size)
        r = self._ranks(ids[:, :size], ids[:, 1:])
        r[(ids[:, :size] < 0) | (ids[:, 1:] < 0)] = -1
        tree[:, size:] = np.where(r >= 0, r << shift | here, _NONE)
        width = size
        while width > 1:
            width //= 2
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            top = tree[rows, 1]
            i, rank = top & ((1 << shift) - 1), top >> shift
            j = right[rows, i]
            nxt, before = right[rows, j], left[rows, i]
            ids[rows, i] = rank
            ids[rows, j] = -1
            right[rows, i] = nxt
            left[rows, np.minimum(nxt, size)] = np.where(nxt <= size, i, left[rows, np.minimum(nxt, size)])
            after = ids[rows, np.minimum(nxt, size)]
            prior = np.where(before >= 0, ids[rows, before], -1)
            for p, a, b in ((i, rank, after), (j, None, None), (before, prior, rank)):
                if a is None:
                    v = np.full(len(rows), _NONE)
                else:
                    r = np.where((a >= 0) & (b >= 0), self._ranks(a, b), -1)
                    v = np.where(r >= 0, r << shift | p, _NONE)
                ok = p >= 0
                k, at = (size + p)[ok], rows[ok]
                tree[at, k] = v[ok]
                k >>= 1
                while len(k) and k[0]:
                    tree[at, k] = np.minimum(tree[at, 2 * k], tree[at, 2 * k + 1])
                    k >>= 1
            rows = rows[tree[rows, 1] < _NONE]
        ids = ids[:, :size]
        kept = ids >= 0
        values, ends = ids[kept].astype(np.int32), np.cumsum(kept.sum(1))
        return [x.tobytes() for x in np.split(values, ends[:-1])]

    def _learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the cache."""
        by_size: dict[int, list[str]] = {}
        for p in pieces:
            n = len(p.encode("utf-8", "surrogatepass"))
            by_size.setdefault(0 if n > _VECTOR_BYTES else max(2, 1 << (n - 1).bit_length()), []).append(p)
        for size, group in by_size.items():
            data = [p.encode("utf-8", "surrogatepass") for p in group]
            if not size or len(group) < 8:
                self.pieces.update((p, self._merge_one(d)) for p, d in zip(group, data))
                continue
            step = max(1, 2_000_000 // size)
            for k in range(0, len(group), step):
                self.pieces.update(zip(group[k : k + step], self._merge_many(data[k : k + step], size)))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of int32."""
        if self.held > _CACHE_BYTES:
            self.units, self.pieces, self.held = {}, {}, 0
        split = [_UNIT.findall(t) for t in texts]
        new = set().union(*split).difference(self.units) if split else set()
        cut = {u: self.pattern.findall(u) for u in new}
        fresh = {p for ps in cut.values() for p in ps}.difference(self.pieces)
        self._learn(fresh)
        piece = self.pieces.__getitem__
        made = {u: b"".join(map(piece, ps)) for u, ps in cut.items()}
        self.units.update(made)
        unit = self.units.__getitem__
        out = [b"".join(map(unit, us)) for us in split]
        for kept, names in ((self.units, made), (self.pieces, fresh)):
            for k in names:
                size = 4 * len(k) + len(kept[k])
                if size > _KEEP_BYTES:
                    del kept[k]
                else:
                    self.held += size + 200
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(rank_file: bytes) -> Encoder:
    """One of each process."""
    if (key := hash(rank_file)) not in _encoders:
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about _BATCH_CHARS characters, nulls as empty ones."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts.to_pylist()):
        run.append(t or "")
        size += len(run[-1])
        if size >= _BATCH_CHARS:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def _ranks_of(spark: SparkSession, path: str):  # noqa: ANN202
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, docs: DataFrame, key: str, text: str, path: str = TOKENIZER_FILE) -> DataFrame:
    """key and ids (array<int>) of every row, without special tokens.

    A null, empty or missing text gives an empty list; a blank one the ids of its blanks; strings of special
    tokens are ordinary text. Texts are encoded whole, whatever their length. Repeated rows give repeated
    results; the key may be null; other columns are ignored; an empty table gives no rows.
    """
    ranks = _ranks_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value)
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                parts = enc.encode_bytes(texts)
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids], names=[key, "ids"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(spark: SparkSession, docs: DataFrame, keys: list[str], text: str, path: str = TOKENIZER_FILE) -> DataFrame:
    """keys and n_tokens (long) of every row: the lengths of encode(), without making the lists."""
    ranks = _ranks_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value)
        for batch in batches:
            for start, texts in _chunks(batch.column(len(keys))):
                sizes = pa.array([len(p) // 4 for p in enc.encode_bytes(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, len(texts)) for i in range(len(keys))), sizes], names=[*keys, "n_tokens"])

    rows = docs.select(*keys, text)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", n_tokens long")


def decoded(spark: SparkSession, ids: DataFrame, key: str, path: str = TOKENIZER_FILE) -> DataFrame:
    """key and data, the bytes that the ids of each row stand for; no ids give no bytes, unknown ids are an error."""
    ranks = _ranks_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {int(r): base64.b64decode(t) for t, r in (line.split() for line in ranks.value.splitlines() if line)}
        for batch in batches:
            data = [b"".join(map(tokens.__getitem__, row or ())) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[key, "data"])

    rows = ids.select(key, "ids")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, data binary")
