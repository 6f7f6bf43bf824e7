"""Mixing sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, its source's target over its source's
size. Its whole part is taken; the fractional parts are rounded together: in a bucket a document
and the smaller ones of its source exchange mass, at random but with expectations kept, until one
side is integral; then pairs of what buckets leave do. The words taken stay the same in every
step. Buckets of documents (by hash,
all sources mixed, so no source is ever in one task) leave at most one fractional document
per source; those residuals meet in a reduction tree of fixed fan-in.

Edge cases: a null text has size 0; documents of size 0 take 0 words; a null source is a
source of its own, last in order; repeated rows are rounded as separate documents; an
empty table gives an empty result. Columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise, prepare, table

#: Documents per bucket, and residuals per node of the reduction tree.
BUCKET, FAN_IN = 4096, 64
#: Sources at most: the driver holds a row for each. More are an error, not cut off.
SOURCES = 100_000
_ROW = "key long, doc_id long, rank int, size long, copies long, p double, bucket long, done boolean"


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """share * sum(sizes) dealt by weight, each at most cap * its size; the excess is dealt again by weight."""
    limits = [cap * s for s in sizes]
    out, open_, left = [0.0] * len(limits), list(range(len(limits))), share * float(sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * per > limits[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * per
            break
        for i in over:
            out[i] = float(limits[i])
            left -= limits[i]
        open_ = [i for i in open_ if weights[i] * per <= limits[i]]
    return out


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round p so that sum(p * size) is kept; returns p and the index left fractional, or -1."""
    p, held, draws = p.astype(float), -1, rng.random(len(p))
    for i in range(len(p)):
        if p[i] <= 1e-12 or p[i] >= 1 - 1e-12 or size[i] <= 0:
            p[i] = round(p[i]) if size[i] > 0 else 0.0
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        if draws[i] < down / (up + down):
            p[held], p[i] = p[held] + up / a, p[i] - up / b
        else:
            p[held], p[i] = p[held] - down / a, p[i] + down / b
        fractional = [j for j in (held, i) if 1e-9 < p[j] < 1 - 1e-9]
        for j in (held, i):
            if j not in fractional:
                p[j] = round(p[j])
        held = fractional[0] if fractional else -1
    return p, held


def pooled(p: float, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """pivot() for documents of one probability, by falling size: each is paired with all smaller ones together.

    Mass goes from or to the smaller ones in proportion, so their probabilities stay equal and keep
    their expectation. Large documents become integral first, and the one left fractional, which the
    source's words may miss their target by, is the smallest (or one larger than all after it).
    """
    out, held, draws, rest = np.zeros(len(size)), -1, rng.random(len(size)), float(size.sum())
    for i, a in enumerate(size.astype(float)):
        if a <= 0:
            continue
        rest -= a
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i] = round(p)
            continue
        if rest <= 0:
            out[i], held = p, i
            continue
        up, down = min(a * (1 - p), rest * p), min(a * p, rest * (1 - p))
        move = up if draws[i] < down / (up + down) else -down
        out[i], p = p + move / a, p - move / rest
        if 1e-9 < out[i] < 1 - 1e-9:
            held = i
        else:
            out[i] = round(out[i])
    return out, held


def _rounder(seed: int, level: int):
    return lambda pdf: _round(pdf, seed, level)


def _round(pdf: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    out = []
    for rank, rows in pdf.sort_values(["rank", "size", "doc_id", "key"], ascending=[True, False, True, True], kind="stable").groupby("rank", sort=True):
        rng = np.random.default_rng([seed, level, int(rank), int(rows["bucket"].iloc[0])])
        # All documents of a source begin with one probability; what is left of buckets differs.
        p, held = pivot(rows["p"].to_numpy(), rows["size"].to_numpy(), rng) if level else pooled(float(rows["p"].iloc[0]), rows["size"].to_numpy(), rng)
        done = np.ones(len(p), bool)
        if held >= 0:
            done[held] = False
        out.append(rows.assign(p=p, done=done))
    return pd.concat(out)[["key", "doc_id", "rank", "size", "copies", "p", "bucket", "done"]]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (of its source), copies, taken, key.

    key is a hash of doc_id, source and text, for joining texts back. The driver holds one
    row per source (name and size), nothing per document.
    """
    prepare(docs.sparkSession)
    sized = docs.select(
        F.xxhash64("doc_id", "source", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    spark = docs.sparkSession
    # Equal rows are counted and numbered, so that they go to buckets of their own whatever their number.
    sized = materialise(sized.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    w = [float(weights[i % len(weights)]) for i in range(len(found))]
    want = targets([r.source_size for r in found], w, share, cap)
    sources = spark.createDataFrame(
        [(i, r.source, r.source_size, t, (t / r.source_size if r.source_size else 0.0)) for i, (r, t) in enumerate(zip(found, want, strict=True))],
        "rank int, source string, source_size long, target double, ratio double",
    )
    buckets = max(1, math.ceil(sum(r.n for r in found) / BUCKET))
    sized = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rows = sized.join(sources.select("rank", "source", "ratio"), sized["source"].eqNullSafe(sources["source"])).select(
        "key", "doc_id", "rank", "size", F.floor("ratio").cast("long").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("p"),
        F.pmod(F.xxhash64("key", "copy", F.lit(seed)), F.lit(buckets)).alias("bucket"),
    )
    level, parts = 0, []
    rows = rows.groupBy("bucket").applyInPandas(_rounder(seed, 0), _ROW)
    while True:
        rows = materialise(rows, "rounded")
        parts.append(rows.where("done"))
        left = rows.where("not done")
        if buckets == 1:
            # One residual per source at most: it is taken with its probability.
            draw = F.pmod(F.xxhash64("doc_id", "rank", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            parts.append(left.withColumn("p", (draw < F.col("p")).cast("double")))
            break
        level, buckets = level + 1, math.ceil(buckets / FAN_IN)
        rows = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).groupBy("rank", "bucket").applyInPandas(_rounder(seed, level), _ROW)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.col("copies") + F.round("p").cast("long")
    return out.join(sources.select("rank", "source_size", "target"), "rank").select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op10_mix_sources": op10_mix_sources}
