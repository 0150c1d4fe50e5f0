"""Usable vectors, their random-projection forests, and their division into cells.

What must be known of all rows before they are divided - the latest row of each chunk, and copies of one
vector - is found on narrow rows of keys and hashes; the vectors themselves are shuffled once, to their
cells, in packed blocks.

The first trees of each model are fitted by the driver on a bounded sample and sent to all tasks; they have
at most SAMPLE / LEAST leaves each, whatever the number of rows. Cells for which more than CELL_MOST rows
are expected are divided again, as often as needed: their trees are fitted in tasks, each on a bounded
sample of its cell, and joined to the cell's blocks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.llm.forest import LEAST, Tree, fit_forest, place
from knotwork.scratch import Scratch
from knotwork.tables import code_key, ref_key

#: Rows of each model, or of each cell that is divided again, that trees are fitted on; every row is indexed.
SAMPLE = 8_000
#: Rows a cell should have, and rows above which a cell is divided again.
CELL_ROWS, CELL_MOST = 2_560, 200_000
#: Trees, and the leaves that a row is placed in.
TREES, PLACES = 2, 4
#: Copies of one direction that stay in the cells: a query counts five neighbours, itself not.
COPIES = 6
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def usable(embeddings: DataFrame, models: DataFrame) -> DataFrame:
    """chunk, model (as models spells it), vec, at, id of the usable rows: the model's length, finite, a norm above 0."""
    m = F.broadcast(models.select(code_key("model").alias("key"), F.col("model").alias("model"), "dim").dropDuplicates(["key"]))  # a fixed table of few rows
    rows = embeddings.select(ref_key("chunk_id").alias("chunk"), code_key("model").alias("key"), F.col("embedding").alias("vec"), F.col("embedded_at").alias("at"), "id").where("chunk is not null")
    rows = rows.join(m, "key").where(F.size("vec") == F.col("dim"))
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))).where((F.array_max("vec") > 0) | (F.array_min("vec") < 0))
    return rows.select("chunk", "model", "vec", "at", "id")


def hashed(rows: DataFrame) -> DataFrame:
    """rows and row_hash of the whole row, and direction: a hash that vectors share whose cosine is 1 when rounded to 9 decimals.

    The grid of directions is so fine that two vectors in one of its boxes have a cosine above 1 - 5e-10.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    scale = F.sqrt(F.size("vec").cast("double")) * 32_000 / norm
    # an array of one, so that the scale is found once a row and not once a number
    boxes = F.transform(F.array(scale), lambda s: F.transform("vec", lambda x: F.floor(x * s)))
    whole = F.struct(F.xxhash64("chunk", "model", "at", "id", "vec").alias("a"), F.xxhash64(F.lit(1), "vec", "id", "at", "model", "chunk").alias("b"))
    return rows.withColumn("row_hash", whole).withColumn("direction", F.xxhash64(boxes))


def latest(rows: DataFrame) -> DataFrame:
    """Of each chunk and model the latest row; among equal times the greatest id. Tasks pass on one row of each before the shuffle."""
    w = Window.partitionBy("chunk", "model").orderBy(F.col("at").desc_nulls_last(), F.col("id").desc_nulls_last())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


class Vectors:
    """The rows that count of a table of vectors: the latest of each chunk and model, and of copies the first few.

    rows: chunk, model, vec, row_hash and what else the table has. held: model, chunk, first - the chunks that are left
    out, and the smallest chunk of the same direction. Rows that are repeated as a whole stay repeated; cells drop them.
    counts: the rows of each model.
    """

    def __init__(self, tmp: Scratch, usable_rows: DataFrame, copies: int = COPIES, unique: bool = False):
        """unique: each chunk and model has one row already, written with its hashes."""
        rows = usable_rows if unique else hashed(usable_rows)
        if unique:
            newest, obsolete = rows.select("chunk", "model", "row_hash", "direction"), None
        else:
            narrow = rows.drop("vec")
            newest = narrow.groupBy("chunk", "model").agg(F.max(F.struct("at", "id", "row_hash", "direction")).alias("r"), F.count("*").alias("n"))
            newest = tmp.cut(newest.select("chunk", "model", "r.row_hash", "r.direction", "n"))
            again = newest.where("n > 1").select("chunk", "model", F.col("row_hash").alias("latest"))
            obsolete = narrow.join(again, ["chunk", "model"]).where("row_hash <> latest").select("row_hash")
        heavy = newest.groupBy("model", "direction").agg(F.count("*").alias("copies"), F.min("chunk").alias("first")).where(F.col("copies") > copies)
        w = Window.partitionBy("model", "direction").orderBy("chunk")
        same = newest.join(heavy, ["model", "direction"])
        # a limit of ranks: each task passes on the first few of a direction only
        kept = same.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= copies).select(F.col("chunk").alias("kept"), F.col("model").alias("kept_model"))
        out = same.join(kept, (F.col("chunk") == F.col("kept")) & (F.col("model") == F.col("kept_model")), "left_anti")
        self.held = tmp.cut(out.select("model", "chunk", "first", "row_hash"))
        dropped = self.held.select("row_hash") if obsolete is None else tmp.cut(obsolete.unionAll(self.held.select("row_hash")).distinct())
        self.rows = rows.join(dropped, "row_hash", "left_anti")
        self.counts = {r["model"]: r["n"] for r in newest.groupBy("model").agg(F.count("*").alias("n")).collect()}  # a row a model


def sampled(rows: DataFrame, counts: dict[str, int], sample: int) -> dict[str, np.ndarray]:
    """Different unit vectors of about sample rows of each model, chosen by their hash; never more than a quarter more."""
    if not counts:
        return {}
    part = F.create_map(*[x for m, n in counts.items() for x in (F.lit(m), F.lit(min(1.0, sample / n)))])[F.col("model")]
    chosen = rows.withColumn("h", F.col("row_hash.a")).where(F.pmod("h", F.lit(1_000_000)) < part * 1_000_000)
    got = chosen.select("model", "h", "vec").orderBy("h").limit(int(1.25 * sample * len(counts))).toArrow()
    names, lists, out = np.array(got["model"].to_pylist(), dtype=object), got["vec"].combine_chunks(), {}
    for m in counts:
        mine = lists.take(pa.array(np.flatnonzero(names == m)))
        x = mine.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(mine), -1) if len(mine) else np.empty((0, 1), np.float32)
        u = unit(x)
        out[m] = u[np.sort(np.unique(np.round(u, 5), axis=0, return_index=True)[1])] if len(u) else u
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] if len(x) else x


def pack(names: pa.Array, x: np.ndarray, home: np.ndarray) -> bytes:
    """A block of rows; the four bytes of the numbers lie apart, for signs and exponents hardly differ."""
    planes = np.ascontiguousarray(x, np.float32).view(np.uint8).reshape(len(x), x.shape[1], 4)
    data = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(planes[:, :, k]))]) for k in range(4)]
    batch = pa.RecordBatch.from_arrays([names, pa.array(home), *data], names=["name", "home", "b0", "b1", "b2", "b3"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(block).read_next_batch()
    dim = batch.schema.field("b0").type.byte_width
    planes = np.empty((batch.num_rows, dim, 4), np.uint8)
    for k in range(4):
        planes[:, :, k] = np.frombuffer(batch.column(2 + k).buffers()[1], np.uint8)[: batch.num_rows * dim].reshape(-1, dim)
    return batch.column(0), planes.view(np.float32)[:, :, 0], batch.column(1).to_numpy(zero_copy_only=False)


def unpack_all(blocks: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The rows of blocks, each name once; as a resident if it is one in any of them."""
    parts = [unpack(b) for b in blocks]
    names, x, home = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    order = np.argsort(~home, kind="stable")
    _, first = np.unique(names.dictionary_encode().indices.to_numpy()[order], return_index=True)
    first = order[first]
    return names.take(pa.array(first)), x[first], home[first]


def _blocks(model: str, cell: int, names: pa.Array, x: np.ndarray, home: np.ndarray, to: np.ndarray) -> Iterator[tuple]:
    """(model, cell, block) of rows (any number of places each, -1 for none)."""
    row, col = np.nonzero(to >= 0)
    where = to[row, col]
    order = np.argsort(where, kind="stable")
    row, where, own = row[order], where[order], home[row[order], col[order]]
    starts = np.r_[0, np.flatnonzero(np.diff(where)) + 1, len(where)]
    for s, e in zip(starts, starts[1:]):
        if e > s:
            yield model, int(cell + where[s]), pack(names.take(pa.array(row[s:e])), x[row[s:e]], own[s:e])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["model", "cell", "block"])


_CELLS = "model string, cell long, block binary"
#: Leaves that the cells of one level are numbered by; tree and leaf are one number below it.
_FAN = 1 << 14


def _number(to_tree: np.ndarray, to_leaf: np.ndarray) -> np.ndarray:
    return np.where(to_leaf >= 0, to_leaf * 8 + to_tree, -1)


def to_cells(spark: SparkSession, rows: DataFrame, counts: dict[str, int], cosine: float, name: str = "chunk", sample: int = SAMPLE, cell_rows: int = CELL_ROWS, cell_most: int = CELL_MOST, trees: int = TREES, places: int = PLACES) -> DataFrame:
    """model, cell, block: each row in its home cell and in as many more as it has places.

    rows: name, model, vec, row_hash. A cell's blocks come in any number of rows of the result.
    """
    cells = {m: min(max(1.0, n / cell_rows), sample / LEAST) for m, n in counts.items()}
    fitted = {m: fit_forest(s.astype(np.float32), cells[m] if len(s) else 1, cosine, trees) for m, s in sampled(rows, counts, sample).items()}
    shared = spark.sparkContext.broadcast(fitted)  # at most sample / LEAST leaves a tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            names, models, vecs = table.column(0).combine_chunks(), table.column(1).combine_chunks().dictionary_encode(), table.column(2).combine_chunks()
            for k, model in enumerate(models.dictionary.to_pylist()):
                take = pa.array(np.flatnonzero(models.indices.to_numpy() == k))
                x = vecs.take(take).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(take), -1)
                to_tree, to_leaf = place(shared.value[model], unit(x).astype(np.float32), places)
                home = np.broadcast_to(np.arange(places) == 0, to_leaf.shape)
                out = list(_blocks(model, 0, names.take(take), x, home, _number(to_tree, to_leaf)))
                if out:
                    yield _batch(out)

    placed = rows.select(name, "model", "vec").mapInArrow(run, _CELLS)
    most = max((n / max(1, fitted[m][0].leaves) for m, n in counts.items()), default=0)
    level = 1
    while most > cell_most:
        placed = _divided(placed, most, cosine, sample, cell_rows, trees, places, level)
        most /= min(most / cell_rows, sample / LEAST / 2)
        level += 1
    return placed


def _divided(placed: DataFrame, most: float, cosine: float, sample: int, cell_rows: int, trees: int, places: int, level: int) -> DataFrame:
    """placed, each of whose cells (of at most about most rows) is divided by trees of its own, fitted in tasks on a sample."""
    rate = min(1.0, sample / most)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for model, cell, block in zip(*(c.to_pylist() for c in batch.columns)):
                names, x, home = unpack(block)
                keep = np.flatnonzero(home & (np.random.default_rng([level, cell, len(x)]).random(len(x)) < rate))
                if len(keep):
                    out.append((model, cell, pack(names.take(pa.array(keep)), x[keep], home[keep])))
            if out:
                yield _batch(out)

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        _, x, _ = unpack_all(table["block"].to_pylist())
        made = fit_forest(unit(x).astype(np.float32), min(len(x) / rate / cell_rows, sample / LEAST), cosine, trees, 7 + level)
        return pa.table({"of_model": [key[0].as_py()], "of_cell": [key[1].as_py()], "trees": [pickle.dumps(made)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            for model, cell, block, made in zip(*(c.to_pylist() for c in batch.columns)):
                if kept[0] != made:
                    kept = (made, pickle.loads(made) if made else None)
                if kept[1] is None:  # no resident was chosen: the cell stays as it is
                    yield _batch([(model, cell * _FAN, block)])
                    continue
                names, x, home = unpack(block)
                to_tree, to_leaf = place(kept[1], unit(x).astype(np.float32), places)
                to = _number(to_tree, to_leaf)
                to[~home, 1:] = -1  # a visitor goes to the one place nearest to it
                homes = (np.arange(places) == 0) & home[:, None]
                out = list(_blocks(model, cell * _FAN, names, x, homes, to))
                if out:
                    yield _batch(out)

    chosen = placed.mapInArrow(choose, _CELLS).groupBy("model", "cell").applyInArrow(grow, "of_model string, of_cell long, trees binary")
    both = placed.join(chosen, (F.col("model") == F.col("of_model")) & (F.col("cell") == F.col("of_cell")), "left")
    return both.select("model", "cell", "block", "trees").mapInArrow(run, _CELLS)


def leaves_within(x: np.ndarray, most: int, cosine: float, trees: int = TREES, places: int = PLACES, seed: int = 11) -> list[np.ndarray]:
    """Rows of the leaves of a cell of unit vectors x: all at once, or by a forest of its own if there are more than most.

    Leaves that a forest leaves too large - it divides no rows that are all alike - are divided again by
    other trees; what can't be divided at all stays together.
    """
    todo, done = [np.arange(len(x))], []
    while todo:
        idx = todo.pop()
        if len(idx) <= most:
            done.append(idx)
            continue
        rng = np.random.default_rng([seed, len(idx)])
        smp = x[rng.choice(len(idx), min(len(idx), 4_096), replace=False)] if len(idx) == len(x) else x[rng.choice(idx, min(len(idx), 4_096), replace=False)]
        forest = fit_forest(smp, min(1.3 * places * len(idx) / most, len(smp) / LEAST), cosine, trees, seed)
        if max(t.leaves for t in forest) == 1:
            done.append(idx)
            continue
        number = _number(*place(forest, x[idx], places))
        row, col = np.nonzero(number >= 0)
        where = number[row, col]
        order = np.argsort(where, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0])
        for part in np.split(row[order], starts[1:]):
            part = idx[np.unique(part)]
            (done if len(part) > 0.8 * len(idx) else todo).append(part)
        seed += 1
    return done


def by_cell(placed: DataFrame, work: Callable[[pa.Array, np.ndarray], pa.Table], schema: str, most: int, cosine: float) -> DataFrame:
    """model and the rows that work makes of the names and stored vectors of each leaf."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, x, _ = unpack_all(table["block"].to_pylist())
        u = unit(x).astype(np.float32) if len(x) > most else x
        out = pa.concat_tables([work(names.take(pa.array(idx)), x[idx]) for idx in leaves_within(u, most, cosine)])
        return out.add_column(0, "model", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    return placed.groupBy("model", "cell").applyInArrow(run, f"model string, {schema}")


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """The batches joined to tables of about rows rows."""
    run, n = [], 0
    for b in batches:
        run.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(run).combine_chunks()
            run, n = [], 0
    if n:
        yield pa.Table.from_batches(run).combine_chunks()
