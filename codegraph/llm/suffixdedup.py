"""Byte-level dedup with suffix arrays built by linear grouping.

Every byte covered by a 400-byte string that starts anywhere else goes, all its occurrences
alike. Seeds deal the corpus into blocks of contexts (see windows). The contexts of a block
are aligned at the seed, and what no other context of the block shares around it is cut off;
contexts with less than a window left are done. Of the rest, the grouping construction (see
gsaca) builds the suffix array, in which suffixes with a common prefix of a window or more
stand side by side: the neighbours in that order, and nothing else, say which windows repeat.

Equal contexts are one class, which repeats whole, and stand in the array once; seeds with
more than BLOCK distinct contexts are settled by an aggregation of their single windows.

strip_documents is the form for pipelines: it leaves the first copy (smallest doc_id) and
takes shorter windows, so that passages of some 50 words are seen.

Edge cases: null texts are empty; texts under 400 bytes lose nothing; matches never cross
documents but may overlap within one; repeated rows of drop_repeated_bytes count as separate
occurrences; spans that kept_text leaves are widened to whole UTF-8 characters, kept_sha256
is of the exact bytes; other columns of the input, whatever their names, play no part; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .gsaca import suffix_array
from .textops import LESS, batches, column, prefix, range_hash
from .windows import Rule, cover, keyed, portions, repeated, values_of, window_hashes

WINDOW, SEED = 400, 128
#: Bytes of the shorter windows of strip_documents: fewer than 51 words of any of the test languages take, and more than a sentence.
PASSAGE, PASSAGE_SEED = 256, 24
#: Symbols of a suffix array; a block is never split, so one may have more.
ARRAY = 1 << 16


def longest_common(pre: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How many values from a and from b on are equal (back: up to a and b), at most `most` each, by bisection over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most + 1
    while (open_ := high - low > 1).any():
        mid = np.where(open_, (low + high) // 2, low)
        same = range_hash(pre, a - mid, a) == range_hash(pre, b - mid, b) if back else range_hash(pre, a, a + mid) == range_hash(pre, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid)
    return low


def _places(seed: np.ndarray, parts: list[bytes], rule: Rule) -> np.ndarray:
    """Where in each part its seed stands first."""
    values, first = values_of(parts, rule)
    at = np.arange(max(0, first[-1] - rule.seed + 1))
    own = np.repeat(np.arange(len(parts)), np.diff(first))[: len(at)]
    hits = np.flatnonzero(range_hash(prefix(values), at, at + rule.seed).view(np.int64) == seed[own])
    return hits[np.searchsorted(hits, first[:-1])] - first[:-1]


def aligned(seed: np.ndarray, parts: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Start and end within each part of what some other part of its block may share around the seed.

    Sorted by what follows the seed, the neighbours of a part share most of it; so for what
    precedes it, read backwards. A repeated window lies within both longest shares.
    """
    place = np.concatenate([_places(seed[low:high], parts[low:high], rule) for low, high in portions(parts)])
    values, first = values_of(parts, rule)
    place += first[:-1]
    pre, kind = prefix(values), np.uint64 if rule.words else np.uint8
    del values
    reach = []
    for back in (False, True):
        whole = [np.frombuffer(x, kind) for x in parts]
        tail = [(x[: p - f][::-1] if back else x[p - f :]).tobytes() for x, p, f in zip(whole, place.tolist(), first.tolist(), strict=False)]
        order = np.array(sorted(range(len(parts)), key=lambda i: (seed[i], tail[i])), np.int64)
        a, b = order[:-1], order[1:]
        room = place - first[:-1] if back else first[1:] - place
        share = np.where(seed[a] == seed[b], longest_common(pre, place[a], place[b], np.minimum(room[a], room[b]), back), 0)
        most = np.zeros(len(parts), np.int64)
        np.maximum.at(most, a, share)
        np.maximum.at(most, b, share)
        reach.append(most)
    return place - first[:-1] - reach[1], place - first[:-1] + reach[0]


def _blocks(seed: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of parts, adjacent by seed, of some ARRAY symbols each; none splits a block."""
    low, total = 0, 0
    for i in range(len(seed)):
        if total >= ARRAY and seed[i] != seed[i - 1]:
            yield low, i
            low, total = i, 0
        total += int(size[i])
    if low < len(seed):
        yield low, len(seed)


def _symbols(pieces: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """One text of all pieces, bytes or ranks of words, each ended by a separator of its own, so that no common prefix runs over an end; and where each starts."""
    size = np.array([len(x) // (8 if rule.words else 1) for x in pieces]) + 1
    base = np.append(0, np.cumsum(size))
    joined = np.frombuffer(b"".join(pieces), np.uint64 if rule.words else np.uint8)
    if rule.words:
        joined = np.unique(joined, return_inverse=True)[1]
    symbols = np.empty(base[-1], np.int32)
    ends = np.zeros(base[-1], bool)
    ends[base[1:] - 1] = True
    symbols[ends] = np.arange(1, len(pieces) + 1)
    symbols[~ends] = joined
    symbols[~ends] += len(pieces) + 1
    return symbols, base


def marked(seed: np.ndarray, doc: np.ndarray, parts: list[bytes], rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """Which windows of each part count, read off the suffix arrays of the blocks."""
    if not parts:
        return
    start, end = aligned(seed, parts, rule)
    unit = 8 if rule.words else 1
    live = np.flatnonzero(end - start >= rule.length)
    for low, high in _blocks(seed[live], (end - start)[live] + 1):
        own = live[low:high]
        pieces = [parts[i][start[i] * unit : end[i] * unit] for i in own]
        symbols, base = _symbols(pieces, rule)
        order = np.array(suffix_array(symbols), np.int32)
        size = np.diff(base).astype(np.int32)
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), size)[order]
        within = order - base[:-1].astype(np.int32)[of]
        whole = size[of] - 1 - within >= rule.length
        of, within = of[whole], within[whole]
        del symbols, order, whole
        # Neighbours with a window in common form a run; the runs are the sets of equal windows.
        hashes, first = window_hashes(pieces, rule)
        hashes = hashes[first[of] + within]
        run = np.cumsum(np.append(True, hashes[1:] != hashes[:-1])) - 1
        if rule.earlier:
            least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, run, doc[own[of]])
            counts = least[run] < doc[own[of]]
        elif rule.apart:
            # Does a run hold a document other than its first?
            docs, first_of = doc[own[of]], np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            counts = np.bincount(run, docs != docs[first_of][run])[run] > 0
        else:
            counts = np.bincount(run)[run] > 1
        flags = np.zeros(first[-1], bool)
        flags[first[of] + within] = counts
        for k, i in enumerate(own.tolist()):
            if flags[first[k] : first[k + 1]].any():
                found = np.zeros(len(parts[i]) // unit - rule.length + 1, bool)
                found[start[i] : start[i] + first[k + 1] - first[k]] = flags[first[k] : first[k + 1]]
                yield i, found


def _strip(texts: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(rows, most=LESS):
            total, gone, runs, sha, kept = [], [], [], [], []
            for i, spans in enumerate(column(batch, "spans").to_pylist()):
                own = data[offs[i] : offs[i + 1]]
                out = cover(len(own), spans) if spans else np.zeros(len(own), bool)
                total.append(len(own))
                gone.append(int(out.sum()))
                runs.append(int((out[1:] & ~out[:-1]).sum() + out[:1].sum()))
                sha.append(hashlib.sha256(own[~out].tobytes() if spans else own.tobytes()).hexdigest())
                if spans and texts:
                    # A character that loses a part only stays whole in the text.
                    head = np.flatnonzero((own & 0xC0) != 0x80)
                    out = np.repeat(np.logical_and.reduceat(out, head), np.diff(np.append(head, len(own))))
                if texts:
                    kept.append(own[~out].tobytes().decode() if spans else own.tobytes().decode())
            yield pa.RecordBatch.from_pydict({"key": column(batch, "key"), "doc_id": column(batch, "doc_id"), "n_bytes": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha)} | ({"kept_text": pa.array(kept, pa.string())} if texts else {}))

    return run


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): key, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept_text."""
    rows = keyed(docs)
    spans = repeated(rows, Rule(window, min(seed, window), False, False), marked)
    return rows.join(spans, "key", "left").select("key", "doc_id", "text", "spans").mapInArrow(_strip(texts), "key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)


def _cut_out(rows: Iterator[pa.RecordBatch], names: list[str], spans_name: str) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in batches(rows, most=LESS):
        text, size, keep = [], [], []
        for i, (old, spans) in enumerate(zip(column(batch, "text").to_pylist(), column(batch, spans_name).to_pylist(), strict=True)):
            if spans:
                own = data[offs[i] : offs[i + 1]]
                out = cover(len(own), spans)
                head = np.flatnonzero((own & 0xC0) != 0x80)
                out = np.repeat(np.logical_and.reduceat(out, head), np.diff(np.append(head, len(own))))
                old = own[~out].tobytes().decode()
            text.append(old)
            size.append(None if old is None else len(old))
            keep.append(not spans or bool(old.strip()))
        new = {c: column(batch, c) for c in names} | {"text": pa.array(text, pa.string())}
        if "n_chars" in new:
            new["n_chars"] = pa.array(size, pa.int64()).cast(new["n_chars"].type)
        yield pa.RecordBatch.from_pydict(new).filter(pa.array(keep))


def strip_documents(docs: DataFrame, window: int = PASSAGE, seed: int = PASSAGE_SEED) -> DataFrame:
    """docs without the bytes of text that strings of `window` bytes cover which a document with a smaller doc_id holds too.

    The first copy of a passage stays. n_chars, if there is one, is set anew in its own type;
    all other columns stay as they are, whatever their names. A text that loses everything but
    white space takes its row along; null and empty texts stay. Rows with a null doc_id come
    last and, like repeated rows of one doc_id, take nothing from each other.
    """
    key, found = fresh(docs, "key", "spans")
    spans = repeated(keyed(docs), Rule(window, min(seed, window), False, True), marked).toDF(key, found)
    both = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(spans, key, "left").drop(key)
    cut: Callable = partial(_cut_out, names=docs.columns, spans_name=found)
    return both.mapInArrow(cut, docs.schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(table(spark, sf_dir, "documents"), texts=False).drop("key")


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
