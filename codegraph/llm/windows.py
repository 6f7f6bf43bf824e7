"""Repeated windows of fixed length across documents, found exactly and without pairs.

A document is a sequence of units (words or bytes). All windows of `length` units with the
same least k-gram (their seed) at the same place form one super-window; its units are its
context. Equal windows share a seed and lie in super-windows of that seed. One row per
super-window is shuffled, not one per window. Equal contexts form a class, of which one
member goes on; the distinct contexts of a seed are its block, which one task compares by
the operator's own method (mark). Seeds with more contexts than BLOCK go through an
aggregation by single window instead, which map-side sums make safe for any skew.

64-bit rolling hashes stand for equality of seeds and contexts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialise, prepare
from .textops import LESS, batches, byte_values, column, longs, mix, prefix, range_hash, sliding_min, word_hashes

#: Distinct contexts of a seed that one task compares; bytes of contexts held at once.
BLOCK, BUFFER = 4096, 1 << 19
#: Bytes of contexts hashed at once.
PORTION = 1 << 17
#: Stands for the documents of a class that several hold, where only documents apart count.
SEVERAL = -(2**63)
_PLACE = np.uint64((1 << 30) - 1)


@dataclass(frozen=True)
class Rule:
    """length and seed in units; earlier: a window counts if it also starts in a document with a smaller id; apart: if in any other document; else if it starts anywhere else."""

    length: int
    seed: int
    words: bool
    earlier: bool
    apart: bool = False


def units(data: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(data, offs) if rule.words else (byte_values(data), offs)


def super_windows(values: np.ndarray, first: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(document, seed hash, context hash, start within the document, number of windows, seed's place) of each super-window."""
    none = np.zeros(0, np.int64)
    if len(values) < rule.length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    pre = prefix(values)
    at = np.arange(len(values) - rule.seed + 1)
    grams = range_hash(pre, at, at + rule.seed)
    least = sliding_min((grams & ~_PLACE) | at.astype(np.uint64), rule.length - rule.seed + 1) & _PLACE
    sizes = np.diff(first)
    valid = np.flatnonzero(np.arange(len(least)) + rule.length <= np.repeat(first[1:], sizes)[: len(least)])
    if not len(valid):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    place = least[valid].astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)
    head = np.flatnonzero(new)
    start, place = valid[head], place[head]
    count = np.diff(np.append(head, len(valid)))
    context = mix(range_hash(pre, start, start + count + rule.length - 1) ^ (place - start).astype(np.uint64))
    doc = np.repeat(np.arange(len(sizes)), sizes)[start]
    return doc, grams[place], context, start - first[doc], count, place - start


def _scan(rule: Rule) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(rows, most=LESS):
            doc, seed, context, start, count, _ = super_windows(*units(data, offs, rule), rule)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([column(batch, "key").take(own), column(batch, "doc").take(own), longs(seed), longs(context), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["key", "doc", "seed", "context", "start", "count"])

    return run


_CUT = "seed long, context long, doc long, edge boolean, hot boolean, count int, units binary"


def _cut(rule: Rule) -> Callable:
    """Contexts (their units) that blocks need, from texts with `wanted` structs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(rows, most=LESS):
            values, first = (word_hashes(data, offs) if rule.words else (data, offs))
            want = column(batch, "wanted")
            flat, bounds = want.flatten(), np.append(0, np.cumsum([len(x) for x in want]))
            fields = [flat.field(i) for i in range(len(flat.type))]
            start, count = (fields[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6))
            begin = np.repeat(first[:-1], np.diff(bounds)) + start
            stop = begin + count + rule.length - 1
            out = pa.array([values[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary())
            seed, context, doc, edge, hot = fields[:5]
            whole = pa.RecordBatch.from_arrays([seed, context, doc, edge, hot, fields[6], out], names=[x.split()[0] for x in _CUT.split(", ")])
            for low in range(0, whole.num_rows, 4096):
                yield whole.slice(low, 4096)

    return run


def values_of(parts: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Values of the units of all parts, and the index of each part's first."""
    joined = b"".join(parts)
    size = 8 if rule.words else 1
    values = np.frombuffer(joined, np.uint64) if rule.words else byte_values(np.frombuffer(joined, np.uint8))
    return values, np.append(0, np.cumsum([len(x) // size for x in parts]))


def portions(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of parts of some PORTION bytes each; at least one, which may be empty."""
    low, total = 0, 0
    for i, part in enumerate(parts):
        if total >= PORTION:
            yield low, i
            low, total = i, 0
        total += len(part)
    yield low, len(parts)


def window_hashes(parts: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of the parts, and the index of each part's first."""
    out, counts = [], []
    for low, high in portions(parts):
        values, first = values_of(parts[low:high], rule)
        count = np.diff(first) - rule.length + 1
        base = np.append(0, np.cumsum(count))
        start = np.arange(base[-1]) + np.repeat(first[:-1] - base[:-1], count)
        out.append(range_hash(prefix(values), start, start + rule.length))
        counts.append(count)
    return np.concatenate(out), np.append(0, np.cumsum(np.concatenate(counts)))


#: For the contexts of blocks (seed hash, document, units of each), adjacent by seed: (index, which of its windows count) of those with any.
Mark = Callable[[np.ndarray, np.ndarray, list[bytes], Rule], Iterator[tuple[int, np.ndarray]]]


def _resolve(rule: Rule, mark: Mark) -> Callable:
    """Of each block (rows of one seed, adjacent), the runs of windows of edge contexts that count."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        seed, context, doc = (column(rows, c).to_numpy() for c in ("seed", "context", "doc"))
        edge = column(rows, "edge").to_numpy(zero_copy_only=False)
        at, runs = [], []
        for i, found in mark(seed, doc, column(rows, "units").to_pylist(), rule):
            if edge[i] and found.any():
                at.append(i)
                runs.append(np.flatnonzero(np.diff(found.astype(np.int8), prepend=0, append=0)).astype(np.int32))
        at = np.array(at, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(seed[at]), pa.array(context[at]), pa.array(runs, pa.list_(pa.int32()))], names=["seed", "context", "runs"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in rows:
            if not batch.num_rows:
                continue
            if size >= BUFFER:
                # Blocks that have ended are compared; the last may go on.
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                seed = column(whole, "seed").to_numpy()
                if seed[-1] != column(batch, "seed")[0].as_py():
                    cut = len(seed)
                else:
                    cut = int(np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))[-1])
                if cut:
                    yield done([whole.slice(0, cut)])
                held = [whole.slice(cut)] if cut < len(seed) else []
                size = sum(x.nbytes for x in held)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield done(held)

    return run


def _single(rule: Rule) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            hashes, base = window_hashes(column(batch, "units").to_pylist(), rule)
            size = np.diff(base)
            own = pa.array(np.repeat(np.arange(batch.num_rows), size))
            at = np.arange(len(hashes)) - np.repeat(base[:-1], size)
            whole = pa.RecordBatch.from_arrays([longs(hashes), column(batch, "seed").take(own), column(batch, "context").take(own), column(batch, "doc").take(own), column(batch, "edge").take(own), pa.array(at.astype(np.int32))], names=["hash", "seed", "context", "doc", "edge", "at"])
            for low in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(low, 1 << 16)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc, doc_id, text): key tells rows with another doc_id or text apart; a null doc_id is last in order."""
    prepare(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("doc"), doc_id.alias("doc_id"), "text")


def repeated(rows: DataFrame, rule: Rule, mark: Mark) -> DataFrame:
    """(key, spans): per row of keyed() with a counting window, structs (a, b) of units that such windows cover."""
    part = rows.select("key", "doc", "text").mapInArrow(_scan(rule), "key long, doc long, seed long, context long, start int, count int")
    part = materialise(part, "superwindows")
    seeds = part.groupBy("seed").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("times"))
    # Written, so that the join deals both sides anew and splits a seed that many rows hold.
    seeds = materialise(seeds.where("least < most" if rule.earlier or rule.apart else "times > 1").select("seed", F.col("least").alias("seed_doc")), "seeds")
    shared = materialise(part.join(seeds, "seed"), "shared")
    free(part, seeds)
    classes = shared.groupBy("context", "seed", "seed_doc").agg(
        F.min("doc").alias("context_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("times"), F.min(F.struct("doc", "key", "start", "count")).alias("rep"),
    )
    classes = classes.withColumn("edge", F.expr("context_doc > seed_doc" if rule.earlier else "context_doc = last_doc" if rule.apart else "times = 1"))
    classes = materialise(classes.withColumn("context_doc", F.expr(f"if(edge, context_doc, {SEVERAL + 1} - 1)")) if rule.apart else classes, "classes")
    blocks = classes.groupBy("seed").agg(F.count("*").alias("members"), F.max("edge").alias("any")).where("any and members > 1").select("seed", (F.col("members") > BLOCK).alias("hot"))
    need = classes.join(blocks, "seed").select(F.col("rep.key").alias("key"), F.struct("seed", "context", F.col("context_doc").alias("doc"), "edge", "hot", "rep.start", "rep.count").alias("w"))
    need = need.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    # One row of each key: a repeated row would give its contexts twice.
    cut = materialise(rows.select("key", "text").dropDuplicates(["key"]).join(need, "key").select("text", "wanted").mapInArrow(_cut(rule), _CUT), "contexts")
    found = cut.where("not hot").repartition("seed").sortWithinPartitions("seed").mapInArrow(_resolve(rule, mark), "seed long, context long, runs array<int>")
    single = cut.where("hot").mapInArrow(_single(rule), "hash long, seed long, context long, doc long, edge boolean, at int")
    hits = single.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("times"))
    counts = "least < doc" if rule.earlier else "least < most" if rule.apart else "times > 1"
    hits = hits.where("true" if rule.earlier else "least < most" if rule.apart else "times > 1")
    hot = single.where("edge").join(hits, "hash").where(counts).groupBy("seed", "context").agg(F.collect_set("at").alias("at"))
    hot = hot.select("seed", "context", F.flatten(F.transform("at", lambda i: F.array(i, i + 1))).alias("runs"))
    found = found.unionByName(hot)
    # Super-windows that repeat whole, and runs within edge contexts, from one join of all places with what was found of their classes.
    # Written too, so that this join can split a context that many places hold.
    settled = materialise(classes.select("seed", "context", "context_doc", F.col("times"), "edge").join(found, ["seed", "context"], "left"), "settled")
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + rule.length).alias("b")))
    inner = F.expr(f"transform(sequence(0, cast(size(runs) / 2 as int) - 1), i -> struct(start + runs[2 * i] as a, start + runs[2 * i + 1] - 1 + {rule.length} as b))")
    span = F.when(F.expr("context_doc < doc" if rule.earlier else "not edge" if rule.apart else "times > 1"), whole).when(F.expr("edge and context_doc = doc and runs is not null"), inner)
    placed = shared.join(settled, ["seed", "context"]).select("key", span.alias("s"))
    spans = materialise(placed.groupBy("key").agg(F.flatten(F.collect_list("s")).alias("spans")).where("size(spans) > 0"), "spans")
    free(shared, classes, cut, settled)
    return spans


def cover(size: int, spans: list[dict] | None) -> np.ndarray:
    """Which of size units the spans (a, b) cover."""
    edge = np.zeros(size + 1, np.int64)
    for s in spans or ():
        edge[s["a"]] += 1
        edge[s["b"]] -= 1
    return np.cumsum(edge[:size]) > 0
