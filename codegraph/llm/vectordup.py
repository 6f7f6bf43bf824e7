"""Near-duplicate vectors: cells of spherical k-means, blocked cosine products inside them, one vector kept a group.

Vectors that are equal in every component form a class; only classes go on. Each of TABLES
independent spherical k-means fits (on at most SAMPLE classes) deals every class to its nearest
centre; a cell beyond SPLIT is dealt out again by centres fitted on a bounded sample of its own.
Cells are compared by blocks of BLOCK rows, and what links there is joined to components. Then
each component is compared in full, again by blocks, and these products give the links, so each
pair is counted once whatever cells it met in.

A group beyond BLOCK rows gets a centre: rows within half the angle of the threshold from it are
linked with each other by the triangle inequality, counted in bulk and joined to their least; only
rows further out meet all others, block by block. So a hot group of near copies costs its size,
and no group has to fit into one task.

Recall: a pair shares no cell of any fit with chance (1 - s)^TABLES, where s is the chance for one
fit, about a half for random vectors at 0.95; pairs joined through others are found regardless.
Tests measure it against brute force. No pair below the threshold is linked.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and stay (n_links 0, component themselves), as does one with a null id (component null).
Only vectors of one dimension meet. Repeated rows (id and vector) are one vector, each row
returned; an id on several vectors joins them. Ties of assignment go to the first centre, groups
are named by their least id. Own columns named n_links, component_id, kept are replaced, other
columns pass. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, free, fresh, materialise, prepare, table
from .textops import column, longs

#: Independent fits; classes a fit may see; rows a cell should have; most centres of a fit.
TABLES, SAMPLE, CELL, CENTRES = 6, 4096, 512, 256
#: Rows of a cell from which it is dealt out again; rows of a block.
SPLIT, BLOCK = 4096, 2048
_ROW = "g long, id long, n long, x array<float>"


def fit(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of the unit rows x, by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        new = centres.copy()
        new[own[order][at]] = np.add.reduceat(x[order], at)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        centres = np.where(size > 0, new / np.maximum(size, 1e-300), centres)
    return centres


def unit(x: pa.Array, rows: int) -> np.ndarray:
    """Rows of lists of one length, in double precision, at length 1. A large component is scaled first, so squares stay finite."""
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batch whose vectors have one dimension, with their unit rows."""
    sizes = column(batch, "x").value_lengths().to_numpy()
    for d in np.unique(sizes):
        part = batch.filter(pa.array(sizes == d))
        yield part, unit(column(part, "x"), part.num_rows)


def _rows(g: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(g), *(column(part, c) for c in ("id", "n", "x"))], names=["g", "id", "n", "x"])


def into_cells(classes: DataFrame, models: dict[int, list[np.ndarray]]) -> DataFrame:
    """classes(id, n, x) once a fit, with g, the cell; vectors of a dimension without centres share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in by_dimension(batch) if batch.num_rows else ():
                for t, centres in enumerate(models.get(x.shape[1], [x[:1] * 0])):
                    yield _rows((x @ centres.T).argmax(1) + ((x.shape[1] * 64 + t) << 16), part)

    return classes.mapInArrow(run, _ROW)


def fitted(classes: DataFrame, tables: int, cell: int) -> dict[int, list[np.ndarray]]:
    """Per dimension the centres of each fit, from a sample of SAMPLE classes that the driver holds."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow().combine_chunks()
    out: dict[int, list[np.ndarray]] = {}
    for whole in sample.to_batches():
        for _, x in by_dimension(whole):
            k = min(CENTRES, max(1, math.ceil(n / cell)))
            halves = [np.random.default_rng(t).permutation(len(x))[: max(1, len(x) * 3 // 4)] for t in range(tables)]
            out[x.shape[1]] = [fit(x[own], k, 1000 + t) for t, own in enumerate(halves)]
    return out


def _cell_centres(level: int, cell: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = max((x for b in t.combine_chunks().to_batches() for _, x in by_dimension(b)), key=len)
        c = fit(x, min(CENTRES, max(2, math.ceil(t.column("m")[0].as_py() / cell))), level)
        return pa.table({"g": [key[0].as_py()], "k": [len(c)], "c": [c.ravel().tolist()]})

    return run


def _dealt_again(level: int):
    def run(own: pa.Table, with_: pa.Table) -> pa.Table:
        out = []
        for whole in own.combine_chunks().to_batches():
            for part, x in by_dimension(whole) if whole.num_rows else ():
                best = np.zeros(part.num_rows, np.uint64)
                if with_.num_rows:
                    c = np.array(with_.column("c")[0].as_py()).reshape(with_.column("k")[0].as_py(), -1)
                    best = (x @ c.T).argmax(1).astype(np.uint64) if c.shape[1] == x.shape[1] else best
                g = column(part, "g").to_numpy().view(np.uint64)
                out.append(_rows((g * np.uint64(0x9E3779B97F4A7C15) + best + np.uint64(level << 20)) * np.uint64(0xD1342543DE82EF95), part))
        return pa.Table.from_batches(out) if out else own.select(["g", "id", "n", "x"])

    return run


def refined(rows: DataFrame, split: int, cell: int, written: list[DataFrame]) -> DataFrame:
    """rows(g, id, n, x) with cells beyond `split` rows dealt out again, as long as that divides them; written gets the tables to free."""
    done, level = None, 0
    while True:
        level += 1
        sizes = materialise(rows.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > split), "cells")
        written.append(sizes)
        if sizes.isEmpty():
            return rows if done is None else rows.unionByName(done)
        calm = rows.join(sizes, "g", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        rows = rows.join(sizes, "g")
        sample = rows.where(F.xxhash64("id", F.lit(level)) % (1 << 40) / float(1 << 40) < F.lit(SAMPLE / 2) / F.col("m"))

        model = sample.groupBy("g").applyInArrow(_cell_centres(level, cell), "g long, k long, c array<double>")
        salts = F.ceil(F.col("m") / 8192).cast("long")
        model = model.join(sizes, "g").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        salted = rows.withColumn("s", F.pmod(F.xxhash64("id"), salts))

        dealt = salted.groupBy("g", "s").cogroup(model.groupBy("g", "s")).applyInArrow(_dealt_again(level), _ROW)
        before = sizes.agg(F.max("m")).first()[0]
        rows = materialise(dealt, "refined")
        written.append(rows)
        if rows.groupBy("g").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] > 0.9 * before:
            return rows.unionByName(done)  # what is left is dense: compare() takes it block by block


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return a @ b.T >= least


def _join(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least label of each connected set of the links (i, j); roots are the labels to begin with."""
    while len(i):
        before = roots.copy()
        low = np.minimum(roots[i], roots[j])
        np.minimum.at(roots, i, low)
        np.minimum.at(roots, j, low)
        if (roots == before).all():
            break
    return roots


_OUT = "id long, links long, root long"


def _found(ids: list[np.ndarray], links: list[np.ndarray], roots: list[np.ndarray]) -> pa.Table:
    each = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, links, roots)]
    return pa.table({c: longs(x) for c, x in zip(("id", "links", "root"), each, strict=True)})


def _whole_groups(least: float):
    """For groups that fit into a block, several at a time."""

    def run(t: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for whole in t.combine_chunks().to_batches():
            for part, x in by_dimension(whole):
                g, ids, n = (column(part, c).to_numpy() for c in ("g", "id", "n"))
                order = np.argsort(g, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                    hit = _linked(x[own], x[own], least)
                    np.fill_diagonal(hit, False)
                    i, j = np.nonzero(hit)
                    out[0].append(ids[own])
                    out[1].append(hit @ n[own])
                    out[2].append(_join(ids[own].copy(), i, j))
        return _found(*out)

    return run


def _block_pairs(least: float):
    """For two blocks of a group (side 0 and 1), or one with itself (side 0 only)."""

    def run(t: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        whole = t.combine_chunks()
        x = unit(whole.column("x").chunk(0), whole.num_rows)
        ids, n, side = (whole.column(c).to_numpy() for c in ("id", "n", "side"))
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if t.column("p")[0].as_py() == t.column("q")[0].as_py():
            hit = _linked(x[own], x[own], least)
            np.fill_diagonal(hit, False)
            other = own
            links = [hit @ n[own]]
        else:
            hit = _linked(x[own], x[other], least)
            links = [hit @ n[other], hit.T @ n[own]]
        i, j = np.nonzero(hit)
        roots = _join(ids.copy(), own[i], other[j])
        for at, count in zip((own, other), links, strict=False):
            out[0].append(ids[at])
            out[1].append(count)
            out[2].append(roots[at])
        return _found(*out)

    return run


def compare(rows: DataFrame, least: float, block: int, written: list[DataFrame]) -> DataFrame:
    """(id, links, root) per row of rows(g, id, n, x), in parts: links of a row within its group, weighed by n, and an id that it reaches there; written gets the tables to free."""
    sizes = materialise(rows.groupBy("g").agg(F.count("*").alias("m")), "sizes")
    written.append(sizes)
    total, most = sizes.agg(F.sum("m"), F.max("m")).first()
    small = sizes.where(F.col("m").between(2, block))
    buckets = max(1, math.ceil((total or 0) / block))
    out = rows.join(small.select("g"), "g").groupBy(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket")).applyInArrow(_whole_groups(least), _OUT)
    if (most or 0) <= block:
        return out
    large = sizes.where(F.col("m") > block)
    rows = rows.join(large, "g").withColumn("d", F.size("x").cast("long"))
    half = math.acos(least) / 2 - 1e-6

    def centre(key: tuple, t: pa.Table) -> pa.Table:
        x = unit(t.combine_chunks().column("x").chunk(0), t.num_rows)
        near = x @ x.T >= math.cos(half)
        c = x[near[near.sum(1).argmax()]].mean(0)
        return pa.table({"g": [key[0].as_py()], "d": [key[1].as_py()], "c": [(c / np.linalg.norm(c)).tolist()]})

    sample = rows.where(F.xxhash64("id", F.lit("centre")) % (1 << 40) / float(1 << 40) < F.lit(1024.0) / F.col("m"))
    centres = sample.groupBy("g", "d").applyInArrow(centre, "g long, d long, c array<double>")

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in by_dimension(batch) if batch.num_rows else ():
                c = column(part, "c")
                inner = np.zeros(part.num_rows, bool)
                has = c.is_valid().to_numpy(zero_copy_only=False)
                if has.any():
                    inner[has] = np.einsum("ij,ij->i", x[has], unit(c.filter(pa.array(has)), int(has.sum()))) >= math.cos(half)
                yield pa.RecordBatch.from_arrays([*(column(part, k) for k in ("g", "id", "n", "x", "m", "d")), pa.array(inner)], names=["g", "id", "n", "x", "m", "d", "inner"])

    sided = materialise(rows.join(centres, ["g", "d"], "left").mapInArrow(sides, f"{_ROW}, m long, d long, inner boolean"), "sided")
    written.append(sided)
    inside = sided.where("inner")
    bulk = inside.groupBy("g", "d").agg(F.sum("n").alias("all"), F.min("id").alias("root"))
    out = out.unionByName(inside.join(bulk, ["g", "d"]).select("id", (F.col("all") - F.col("n")).alias("links"), "root"))
    # Outer blocks are numbered from 0, inner blocks after them; every pair of blocks but two inner ones meets once.
    counts = sided.groupBy("g", "d").agg(F.count(F.when(~F.col("inner"), 1)).alias("far"), F.count("*").alias("whole"))
    counts = counts.select("g", "d", F.ceil(F.col("far") / block).cast("long").alias("b"), F.ceil((F.col("whole") - F.col("far")) / block).cast("long").alias("c"))
    own = F.when(F.col("inner"), F.col("b") + F.pmod(F.xxhash64("id"), "c")).otherwise(F.pmod(F.xxhash64("id"), "b"))
    meets = sided.join(counts, ["g", "d"]).where("b > 0").withColumn("own", own)
    last = F.when(F.col("inner"), F.col("b")).otherwise(F.col("b") + F.col("c"))
    meets = meets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    meets = meets.select("g", "d", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "x")
    return out.unionByName(meets.groupBy("g", "d", "p", "q").applyInArrow(_block_pairs(least), _OUT))


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.95, tables: int = TABLES, cell: int = CELL, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """vectors with n_links, component_id and kept: other vectors linked directly, least id reachable, whether the row has that id."""
    prepare(vectors.sparkSession)
    vectors = vectors.drop(*(c for c in vectors.columns if c.lower() in ("n_links", "component_id", "kept")))
    h, k, o = fresh(vectors, "h", "k", "o")
    x = F.col(vector_column)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    valid = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    keyed = vectors.withColumn(h, F.when(valid, F.xxhash64(x))).withColumn(k, F.when(valid, F.xxhash64(F.lit(1), x)))
    known = keyed.where(F.col(h).isNotNull()).select(h, k, F.col(id_column).cast("long").alias("id"), x.cast("array<float>").alias("x"))
    classes = known.groupBy(h, k, "id").agg(F.first("x").alias("x")).groupBy(h, k)
    classes = materialise(classes.agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min_by("x", "id").alias("x")), "classes")
    each = classes.select("id", "n", "x")
    written: list[DataFrame] = []
    cells = refined(into_cells(each, fitted(each, tables, cell)), split, cell, written)
    hooks = compare(cells, least, block, written).where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
    found = components(hooks)
    free(*written)
    groups = materialise(found.select(F.col("u").alias("id"), "root").unionByName(found.select(F.col("root").alias("id"), "root").distinct()), "groups")
    links = compare(each.join(groups, "id").select(F.col("root").alias("g"), "id", "n", "x"), least, block, []).groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.select(h, k, "id", "n").join(groups, "id", "left").join(links, "id", "left")
    told = told.select(h, k, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias(o))
    out = keyed.join(told, [h, k], "left").withColumn("component_id", F.coalesce(o, F.col(id_column).cast("long")))
    kept = F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True))
    return out.select(*(F.col(c) for c in vectors.columns), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_duplicate_vectors(vectors).drop("embedding")


QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
