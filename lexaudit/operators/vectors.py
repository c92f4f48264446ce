"""Nearest vectors by an index of cells, exact by bounds.

Items are dealt to the cell of the centre that they are most like; centres are fitted to a sample of at most
``SAMPLE`` items, everything else covers all. A cell keeps its least and greatest angle to the centre. Of a query
at angle p, no item of a cell with angles a to b is closer than max(0, p - b, a - p). A first search covers the
``PROBES`` closest cells of each query; a second one all other cells that this bound doesn't exclude, so that the
result is that of all pairs.

Queries and items meet by (cell, share of the cell, share of its queries): a group multiplies at most ``ROWS`` by
``QUERIES`` vectors and passes on the best of each query, so no pair is a row, no cell is in one task, and no
vector goes through the driver but the sample. Vectors that have no direction to speak of (isotropic noise)
are in no closed cells: bounds exclude little there, and the work is that of all pairs, dealt out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit.session import cut

SAMPLE, ROUNDS, MAX_CELLS = 20_000, 12, 256
PROBES = 4
ROWS, QUERIES = 4_000, 1_000
_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
#: Results are rounded to six digits, so that a bound must fall short by more than that.
_SLACK = 2e-6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(len(column), width)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, size, out=np.zeros(v.shape), where=size > 0)


def _packed(rows: DataFrame, ident: str, vector: str, name: str) -> DataFrame:
    """(name, v): ids and vectors as bytes of doubles; null vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.float64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], [name, "v"])

    return rows.filter(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias(name), F.col(vector).cast("array<double>").alias("w")).mapInArrow(run, f"{name} long, v binary")


@dataclass
class Cells:
    """The centres, and each cell's number of items and range of similarities to its centre: what tasks need."""

    centres: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that an item of each cell can be like each query."""
        u = _unit(queries)
        p = np.arccos(np.clip(u @ self.centres.T, -1, 1))
        nearest, farthest = np.arccos(np.clip(self.high, -1, 1)), np.arccos(np.clip(self.low, -1, 1))
        best = np.cos(np.maximum(0, np.maximum(p - farthest, nearest - p)))
        best[(u * u).sum(1) == 0] = 0.0
        best[:, self.low <= 0] = np.maximum(best[:, self.low <= 0], 0.0)  # may hold vectors without a length, which are like nothing
        return np.where(self.size > 0, best, -np.inf)


@dataclass
class CellIndex:
    """Items by cell, and the cells."""

    items: DataFrame
    cells: Cells


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit length, by rounds of assignment and means from a seeded choice of the sample."""
    r = np.random.default_rng(1)
    centres = sample[r.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        moved = _unit(sums)
        centres = np.where((moved * moved).sum(1, keepdims=True) > 0, moved, centres)
    return centres


def cell_index(items: DataFrame, ident: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> CellIndex | None:
    """An index of all items whose vector isn't null; null if there are none. Vectors of other lengths than most raise."""
    packed = _packed(items, ident, vector, "id")
    widths = items.filter(F.col(vector).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if not widths["n"]:
        return None
    if widths["a"] != widths["b"] or not widths["a"]:
        raise ValueError(f"vectors of {widths['a']} to {widths['b']} numbers")
    width = widths["a"]
    some = packed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = _unit(np.frombuffer(b"".join(bytes(r["v"]) for r in some)).reshape(len(some), width))
    sample = sample[(sample * sample).sum(1) > 0]
    if not len(sample):
        sample = np.eye(1, width)
    cells = max(1, min(cells or MAX_CELLS, int(np.sqrt(widths["n"])) + 1, len(sample)))
    centres = _fitted(sample, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = _unit(_matrix(batch.column("v"), width)) @ centres.T
                own = like.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(like[np.arange(len(own)), own]), batch.column("id"), batch.column("v")], ["cell", "like", "id", "v"])

    placed = cut(packed.mapInArrow(assign, "cell int, like double, id long, v binary"))
    size, low, high = np.zeros(cells), np.ones(cells), -np.ones(cells)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("like").alias("a"), F.max("like").alias("b")).collect():
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["a"] - 1e-9, r["b"] + 1e-9
    return CellIndex(placed, Cells(centres, size, low, high))


def _searched(index: CellIndex, asked: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Of (query_id, v, cell) requests: (query_id, id, similarity), each group's best; and the number of products."""
    wanted = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
    parts = [max(1, -(-int(n) // ROWS)) for n in index.cells.size]
    queries = [max(1, -(-wanted.get(c, 0) // QUERIES)) for c in range(len(parts))]
    table = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell"))
    left = index.items.withColumn("part", F.pmod(F.xxhash64("id"), table(parts)).cast("int")).filter(F.col("cell").isin([c for c in wanted])).withColumn("share", F.explode(F.sequence(F.lit(0), table(queries) - 1)))
    right = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), table(queries)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), table(parts) - 1)))
    width = index.cells.centres.shape[1]

    def best(items: pa.Table, some: pa.Table) -> pa.Table:
        if not items.num_rows or not some.num_rows:
            return _FOUND.empty_table()
        own, ids = _unit(_matrix(items.column("v").combine_chunks(), width)), items.column("id").to_numpy()
        q, names = _unit(_matrix(some.column("v").combine_chunks(), width)), some.column("query_id").to_numpy()
        top_ids, top = [], []
        for a in range(0, len(q), QUERIES):
            like = np.round(q[a : a + QUERIES] @ own.T, 6)
            order = np.lexsort((np.broadcast_to(ids, like.shape), -like), axis=1)[:, :k]
            top_ids.append(ids[order])
            top.append(np.take_along_axis(like, order, 1))
        top_ids, top = np.concatenate(top_ids), np.concatenate(top)
        return pa.Table.from_arrays([pa.array(np.repeat(names, top.shape[1])), pa.array(top_ids.ravel()), pa.array(top.ravel() + 0.0)], schema=_FOUND)

    keys = ["cell", "part", "share"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, id long, similarity double")
    return found, sum(int(index.cells.size[c]) * n for c, n in wanted.items())


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: CellIndex | None, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", probes: int = PROBES) -> tuple[DataFrame, int]:
    """The k most similar items of each query vector, (query_id, id, similarity, rank), ties by id; and how many products that took.

    Similarities are cosines rounded to six digits, 0 where a vector has no length. Null query vectors have no rows."""
    asked = cut(_packed(queries, ident, vector, "query_id"))
    if index is None or k < 1:
        return asked.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int"), 0

    cells, width = index.cells, index.cells.centres.shape[1]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bounds = cells.bounds(_matrix(batch.column("v"), width))
                closest = np.argsort(-bounds, axis=1, kind="stable")[:, :probes]
                n = closest.shape[1]
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("v").take(at), pa.array(closest.ravel().astype(np.int32))], ["query_id", "v", "cell"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bounds = cells.bounds(_matrix(batch.column("v"), width))
                closest = np.argsort(-bounds, axis=1, kind="stable")[:, :probes]
                least = batch.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
                open_ = bounds + _SLACK >= least[:, None]
                np.put_along_axis(open_, closest, False, axis=1)
                open_ &= cells.size > 0
                at, cell = np.nonzero(open_)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(rows), batch.column("v").take(rows), pa.array(cell.astype(np.int32))], ["query_id", "v", "cell"])

    kind = "query_id long, v binary, cell int"
    near = cut(asked.mapInArrow(first, kind))
    some, products = _searched(index, near, k)
    if len(cells.size) <= probes:
        return _ranked(some, k), products
    found = cut(_ranked(some, k))
    least = found.filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("similarity").alias("least"))
    rest = cut(asked.join(least, F.col("query_id") == F.col("q"), "left").select("query_id", "v", "least").mapInArrow(second, kind))
    others, more = _searched(index, rest, k)
    return _ranked(found.select("query_id", "id", "similarity").unionByName(others), k), products + more
