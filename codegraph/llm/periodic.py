"""Periodic runs of words: found by probing a grid of each period, extended by chunks, collapsed to one period.

A run is a stretch of consecutive words with smallest period q and length >= max(least, times * q)
that no neighbouring word extends keeping period q. For each period p the words at the grid points
jp and (j+1)p are compared; a run of period p is long enough to hold a grid point from which
`room` words in a row equal those p further on, so a few of these are compared too. What survives
is extended to both sides by comparing chunks of growing size. Periods go upwards: grid points
inside a found run whose period divides p are skipped, since the stretch of period p through them
is that run. A text costs n log n comparisons for n words.

Words are compared by exact codes. Each text is one row and handled alone and whole; nothing is
shuffled, so a lost executor costs its own rows only.

Edge cases: null texts have no words, no run and an empty collapsed text; texts shorter than a run
have none, but their words are still joined by one space; repeated rows are handled alike; runs of
equal length and period are all listed, by start, then period. Own columns named n_words, runs or
collapsed are replaced; other columns pass. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, prepare, table
from .textops import batches

#: Least words of a run, and least times its period.
LEAST, TIMES = 24, 3
#: Grid points compared at once, and words of the first chunk of an extension.
PROBES, CHUNK = 1 << 21, 64


def _extent(codes: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The widest [start, end) around at in which words p apart are equal."""
    end, size = at, CHUNK
    while end + p < len(codes):
        wrong = codes[end : end + size][: len(codes) - p - end] != codes[end + p : end + p + size]
        if wrong.any():
            end += int(wrong.argmax())
            break
        end, size = end + len(wrong), size * 2
    start, size = at, CHUNK
    while start:
        low = max(0, start - size)
        wrong = codes[low:start] != codes[low + p : start + p]
        if wrong.any():
            start -= int(wrong[::-1].argmax())
            break
        start, size = low, size * 2
    return start, end + p


def find_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; times is 3 at least."""
    n = len(codes)
    periods = np.arange(1, n // times + 1 if n >= least else 1)
    ends = np.cumsum((n - 1) // np.maximum(periods, 1))
    known: dict[int, tuple[list[int], list[int]]] = {}  # period: starts and ends of its runs
    found: dict[tuple[int, int], int] = {}
    low = 0
    while low < len(periods):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PROBES)))
        own = periods[low:high]
        many = (n - 1) // own
        p = np.repeat(own, many)
        at = (np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)) * p
        low = high
        same = codes[at] == codes[at + p]
        at, p = at[same], p[same]
        room = np.maximum(least, times * p) - 2 * p + 1
        for part in (4, 3, 2, 1):
            there = at + (room - 1) * part // 4
            there[there + p >= n] = 0  # no run goes so far
            same = (codes[there] == codes[there + p]) & (there >= at)
            at, p, room = at[same], p[same], room[same]
        values, first = np.unique(p, return_index=True)
        for q, points in zip(values.tolist(), np.split(at, first[1:]) if len(at) else [], strict=True):
            for d in [d for d in known if q % d == 0]:
                starts, stops = (np.array(x) for x in known[d])
                inside = np.searchsorted(starts, points, "right") - 1
                points = points[(inside < 0) | (points + q >= stops[inside])]
            i = 0
            new = []
            while i < len(points):
                start, end = _extent(codes, int(points[i]), q)
                if end - start >= max(least, times * q) and (start, end) not in found:
                    found[start, end] = q
                    new.append((start, end))
                i = max(i + 1, int(np.searchsorted(points, end - q)))
            if new:
                known[q] = tuple(map(list, zip(*sorted(new), strict=True)))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words, runs array<struct<start, length, period>> and collapsed, the text without the words that a run holds after its first period."""
    if times < 3:
        raise ValueError("a run holds its period three times at least")
    prepare(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "runs", "collapsed")))
    names = [*docs.columns, "n_words", "runs", "collapsed"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(rows):
            counts, sizes, flat, texts = [], [], [], []
            for low, high in zip(offs[:-1], offs[1:], strict=True):
                words = data[low:high].tobytes().split()  # at the bytes 0x20 and 0x09 to 0x0D
                codes: dict[bytes, int] = {}
                found = find_runs(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)), least, times)
                if found:
                    step = np.zeros(len(words) + 1, np.int64)
                    for start, length, q in found:
                        step[start + q] += 1
                        step[start + length] -= 1
                    words = [w for w, k in zip(words, (np.cumsum(step[:-1]) == 0).tolist(), strict=True) if k]
                    counts.append(len(step) - 1)
                else:
                    counts.append(len(words))
                sizes.append(len(found))
                flat += found
                texts.append(b" ".join(words).decode())
            parts = np.array(flat, np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], ["start", "length", "period"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), spans, pa.array(texts)], names=names)

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{own}n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_runs_planted(docs: DataFrame) -> DataFrame:
    """docs whose texts hold the runs that the contract asks for: in one document in ten the words from a on repeat the p words there."""
    words, h, n, a, p = fresh(docs, "words", "h", "n", "a", "p")
    g = F.expr(f"{h} div 10")
    planted = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string")))
    planted = planted.withColumn(words, F.when(F.col(h) % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    planted = planted.withColumn(n, F.size(words).cast("long")).withColumn(a, F.when(F.col(n) > 0, g % F.col(n)))
    planted = planted.withColumn(p, 1 + F.expr(f"({n} - {a}) div (3 + ({h} div 10) % 8)"))
    at = lambda i: F.get(words, F.when(i < F.col(a), i).otherwise(F.col(a) + (i - F.col(a)) % F.col(p)).cast("int"))
    text = F.when(F.col(n) > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), at), " ")).otherwise(F.col("text"))
    return planted.withColumn("text", text).select(*docs.columns)


def _digest(runs: Column) -> Column:
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), ""), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_runs_planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = collapse_runs(docs).drop("text")
    runs = F.col("runs")
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    found = found.withColumn("best", F.aggregate(runs, none, longer))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), *best, milli, _digest(runs).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
