"""Exact nearest neighbours: vectors in cells around pivots, cells and vectors skipped by the triangle inequality.

At most PIVOTS pivots are fitted on SAMPLE vectors, those with the least hash of vec_id. Every
vector belongs to its nearest pivot; cells are cut to blocks of BLOCK vectors. Each query first
meets the nearest cells that hold k vectors; the k-th distance there bounds what the other cells
can add, so of them only those remain that the bound reaches, and in them the vectors whose own
distance to the pivot it reaches. Queries and vectors meet by an equi-join on (cell, block): no
product of both, whatever their sizes. What meets is measured as a matrix product and cut to k
for each query within its task; only those near the k-th are measured term by term, in the order
of the metric's own expression, so distances and ties are those of the expression.

The driver holds the pivots and a row for each cell, both bounded by PIVOTS. A metric without a
known form that obeys the triangle inequality (see _TRUE) meets all blocks, a row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import squared_l2
from ..storage import materialise, ship

#: Pivots at most, vectors they are fitted on, vectors of a block; slack of bounds against rounding.
PIVOTS, SAMPLE, BLOCK, SLACK = 64, 4096, 8192, 1e-6
#: Queries that a block of vectors meets at once; elements of a matrix of distances; pairs measured term by term at once.
ASKED, CELLS, PAIRS = 8192, 1 << 21, 1 << 16


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    size = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.arccos(np.clip(size(x) @ size(pivots).T, -1, 1))


def _straight(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = lambda v: (v * v).sum(1)
    return np.sqrt(np.maximum(square(x)[:, None] + square(pivots)[None, :] - 2 * x @ pivots.T, 0))


#: By metric: distances to pivots that obey the triangle inequality, and what turns the metric into them.
_TRUE = {
    cosine_distance: (_angles, lambda d: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d)))),
    squared_l2: (_straight, lambda d: F.sqrt(F.greatest(F.lit(0.0), d))),
}


def _cosines(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances nearly, and by how much at most each row of them is off."""
    size = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return 1 - size(q) @ size(v).T, np.full(len(q), 1e-9)


def _squares(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (q * q).sum(1), (v * v).sum(1)
    return a[:, None] + b[None, :] - 2 * (q @ v.T), 1e-9 * (1 + a + b.max())


def _sum(terms: Iterator[np.ndarray]) -> np.ndarray:
    """Terms added one after another, as F.aggregate does."""
    return sum(terms, 0.0)


def _exact_cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    dot = lambda x, y: _sum(x[:, i] * y[:, i] for i in range(x.shape[1]))
    return 1 - dot(v, q) / (np.sqrt(dot(v, v)) * np.sqrt(dot(q, q)))


def _exact_square(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _sum((v[:, i] - q[:, i]) * (v[:, i] - q[:, i]) for i in range(v.shape[1]))


#: By metric: distances of a block as a matrix, and of pairs term by term.
_BLOCKS = {cosine_distance: (_cosines, _exact_cosine), squared_l2: (_squares, _exact_square)}


def _met(metric: Callable, k: int, names: tuple[str, str], bounded: bool):
    """The k nearest of a block's vectors for each query that asks it, ties by vec_id; bounded leaves out what the triangle inequality rules out."""
    near, exact = _BLOCKS[metric]

    def run(asked: pa.Table, placed: pa.Table) -> pa.Table:
        asked, placed = asked.combine_chunks(), placed.combine_chunks()
        at, which, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and placed.num_rows:
            q, v = (_matrix(t[c].combine_chunks(), t.num_rows) for t, c in ((asked, "query"), (placed, "embedding")))
            place = np.empty(len(v), np.int64)
            place[pc.sort_indices(placed["vec_id"], null_placement="at_start").to_numpy()] = np.arange(len(v))
            if bounded:
                away, bound, r = asked["away"].to_numpy(), asked["bound"].to_numpy(), placed["r"].to_numpy()
            step = max(1, CELLS // len(v))
            for low in range(0, len(q), step):
                rough, slack = near(q[low : low + step], v)
                if bounded:
                    rough[np.abs(away[low : low + step, None] - r[None, :]) > bound[low : low + step, None]] = np.inf
                last = np.partition(rough, k - 1, 1)[:, k - 1] if len(v) > k else np.full(len(rough), np.inf)
                i, j = np.nonzero((rough <= (last + 2 * slack)[:, None]) & (rough < np.inf))
                far = np.concatenate([np.zeros(0), *(exact(v[j[x : x + PAIRS]], q[low + i[x : x + PAIRS]]) for x in range(0, len(i), PAIRS))])
                order = np.lexsort((place[j], far, i))
                i, j, far = i[order], j[order], far[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                at.append(low + i[first])
                which.append(j[first])
                d.append(far[first])
        return pa.table({names[0]: asked["query_id"].take(pa.array(np.concatenate(at))), names[1]: placed["vec_id"].take(pa.array(np.concatenate(which))), "d": pa.array(np.concatenate(d))})

    return run


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Centres of the sample by k-means; rows of the sample stand in for empty ones."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(PIVOTS, max(1, len(sample) // 8)), replace=False)]
    for _ in range(8):
        own = _straight(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(centres))[:, None]
        new = np.where(count > 0, sums / np.maximum(count, 1), centres)
        centres = np.where(np.abs(new).sum(1, keepdims=True) > 0, new, centres)
    return centres


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _placed(pivots: np.ndarray, far: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = far(_matrix(b.column(1), b.num_rows), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "embedding", "cell", "r"])

    return run


def _asks(pivots: np.ndarray, far: Callable, cells: list[tuple[int, int, float, float]], k: int):
    """For each query and cell: its distance to the pivot, the least a vector of the cell can be away, and whether the cell is among the first."""
    which = np.array([c[0] for c in cells])
    sizes, low, high = (np.array([c[i] for c in cells], float) for i in (1, 2, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = far(_matrix(b.column(1), b.num_rows), pivots)[:, which]
                least = np.maximum(np.maximum(d - high, low - d), 0)
                order = np.argsort(d, 1, kind="stable")
                held = np.cumsum(sizes[order], 1) - sizes[order]
                first = np.empty(d.shape, bool)
                np.put_along_axis(first, order, held < k, 1)
                n, m = d.shape
                at = np.repeat(np.arange(n), m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.tile(which, n), pa.int32()), pa.array(d.ravel()), pa.array(least.ravel()), pa.array(first.ravel())], names=["query_id", "cell", "away", "least", "first"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: Callable[[Column, Column], Column] = cosine_distance, literal: Column | None = None) -> DataFrame:
    """(query_id, vec_id, rank, distance): exact nearest by the metric, for any number of queries(query_id, query); ties by vec_id.

    literal restricts the vectors beforehand, as a filter on their metadata. Vectors and queries that
    are null or hold null or non-finite components, or have another dimension than most of the
    sample, have no neighbours; under the cosine neither have zero vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    far, true = _TRUE.get(metric, (_straight, None))

    def sound(x: Column) -> Column:
        whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return whole & F.exists(x, lambda v: v != 0) if metric is cosine_distance else whole

    own = vectors if literal is None else vectors.where(literal)
    own = own.select("vec_id", "embedding").where(sound(F.col("embedding")))
    asked = queries.select("query_id", "query").where(sound(F.col("query")))
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).to_pylist()
    kind = own.schema["vec_id"].dataType.simpleString()
    out = "query_id {}, vec_id {}, d double".format(queries.schema["query_id"].dataType.simpleString(), kind)
    if not sample:
        return spark.createDataFrame([], out).select("query_id", "vec_id", F.lit(0).cast("long").alias("rank"), F.col("d").alias("distance"))
    dimension = max({len(x) for x in sample}, key=[len(x) for x in sample].count)
    pivots = _pivots(np.array([x for x in sample if len(x) == dimension], np.float64))
    own, asked = own.where(F.size("embedding") == dimension), asked.where(F.size("query") == dimension)
    placed = materialise(own.mapInArrow(_placed(pivots, far), f"vec_id {kind}, embedding {own.schema['embedding'].dataType.simpleString()}, cell int, r double"), "placed")
    cells = [tuple(c) for c in placed.groupBy("cell").agg(F.count("*"), F.min("r"), F.max("r")).orderBy("cell").collect()]
    blocks = F.create_map(*(F.lit(x) for c in cells for x in (c[0], max(1, -(-c[1] // BLOCK)))))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks[F.col("cell")].cast("long")))
    asks = asked.mapInArrow(_asks(pivots, far, cells, k), f"query_id {queries.schema['query_id'].dataType.simpleString()}, cell int, away double, least double, first boolean")
    asks = materialise(asks, "asks")

    def meet(side: DataFrame, near: Column | None) -> DataFrame:
        side = side.join(asked, "query_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks[F.col("cell")].cast("long") - 1)))
        both = side.join(placed, ["cell", "block"])
        both = both if near is None else both.where(near)
        return both.select("query_id", "vec_id", metric(F.col("embedding"), F.col("query")).alias("d"))

    parts = max(1, -(-asked.count() // ASKED)) if metric in _BLOCKS else 1
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))

    def met(side: DataFrame, bounded: bool) -> DataFrame:
        """meet() by blocks: a block of vectors comes together with all queries that ask it, ASKED or so at most."""
        side = side.join(asked, "query_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks[F.col("cell")].cast("long") - 1))).withColumn("part", part)
        there = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        both = side.groupBy("cell", "block", "part").cogroup(there.groupBy("cell", "block", "part"))
        return both.applyInArrow(_met(metric, k, ("query_id", "vec_id"), bounded), out)

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id"))
    best = lambda rows: rows.withColumn("rank", rank).where(F.col("rank") <= k)
    if true is None:
        found = best(meet(asks, None))
    else:
        begun = materialise(best(met(asks.where("first"), False) if metric in _BLOCKS else meet(asks.where("first"), None)), "begun")
        bound = begun.groupBy("query_id").agg((true(F.max("d")) + SLACK).alias("bound"))
        rest = asks.where("not first").join(bound, "query_id").where(F.col("least") <= F.col("bound"))
        more = met(rest, True) if metric in _BLOCKS else meet(rest, F.abs(F.col("away") - F.col("r")) <= F.col("bound"))
        found = best(begun.drop("rank").unionByName(more))
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("d", 6).alias("distance"))
