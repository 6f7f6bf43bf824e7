"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks of reference text.

The reference of a document is every document with a smaller id. It is dealt into blocks by
seed (see windows): all places where a window of 50 words of the document may stand in the
reference are in the blocks of its seeds, so each document meets only the blocks that it can
have factors in. Within a block contexts are parsed in order of their documents. The index
holds, for each window of words that was new when it was read, where it was read first. A
parse takes the longest factor that the indexed context at its place yields, verified word by
word; a factor of 50 words or more is a duplicate span. Windows across a factor's end may
still stand elsewhere, so the parse goes on at the first window that the factor doesn't hold.
Windows that no factor covers are new and enter the index after their document.

Equal contexts are one class and are parsed once; seeds with more than BLOCK distinct
contexts are settled by an aggregation of their single windows.

Edge cases: null texts and texts under 50 words lose nothing; an exact copy of 50 words or
more loses all words; windows are judged on the input; a null doc_id comes last in order;
repeated rows of one doc_id don't remove each other; other columns of the input, whatever
their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textops import LESS, batches, column, word_spans
from .windows import Rule, cover, keyed, repeated, window_hashes

WINDOW = 50


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = a[:n] != b[:n]
    return int(apart.argmax()) if apart.any() else n


def factors(seed: np.ndarray, doc: np.ndarray, parts: list[bytes], rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """Which windows of each part are in factors of parts of the same block and a smaller document, by greedy parsing."""
    hashes, base = window_hashes(parts, rule)
    words = [np.frombuffer(x, np.uint64) for x in parts]
    order = np.lexsort((doc, seed))
    index: dict[int, tuple[int, int]] = {}
    new: list[tuple[int, int, int]] = []
    last = None
    for i in order.tolist():
        if last is None or seed[i] != seed[last]:
            index, new = {}, []
        elif doc[i] != doc[last]:
            for h, j, p in new:
                index.setdefault(h, (j, p))
            new = []
        last = i
        own = hashes[base[i] : base[i + 1]].tolist()
        found = np.zeros(len(own), bool)
        at = 0
        while at < len(own):
            place = index.get(own[at])
            size = common_length(words[i][at:], words[place[0]][place[1] :]) if place else 0
            if size >= rule.length:
                end = at + size - rule.length + 1
                found[at:end] = True
                at = end
            else:
                new.append((own[at], i, at))
                at += 1
        if found.any():
            yield i, found


def _strip(texts: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(rows, most=LESS):
            starts, ends, first = word_spans(data, offs)
            raw = data.tobytes()
            total, gone, sha, kept = [], [], [], []
            for i, spans in enumerate(column(batch, "spans").to_pylist()):
                a, b = first[i], first[i + 1]
                n = int(b - a)
                if spans:
                    out = cover(n, spans)
                    left = b" ".join([raw[starts[a + j] : ends[a + j]] for j in np.flatnonzero(~out)])
                    gone.append(int(out.sum()))
                else:
                    left = b" ".join(raw[offs[i] : offs[i + 1]].split())
                    gone.append(0)
                total.append(n)
                sha.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode())
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha)} | ({"kept_text": pa.array(kept, pa.string())} if texts else {}))

    return run


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text."""
    rows = keyed(docs)
    spans = repeated(rows, Rule(window, max(1, window // 5), True, True), factors)
    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_strip(texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(table(spark, sf_dir, "documents"), texts=False)


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
