"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a trigram's vector binds (multiplies) the
vectors of its letters, the first permuted twice and the second once; a text's vector
bundles (adds) those of all its trigrams. A language's prototype bundles its training
texts, each scaled to length one, and a text takes the language whose prototype has the largest cosine.
Letters are lower-cased; a run of anything else counts as one blank.

Edge cases: null texts and texts without letters get `und` with score 0; rows with null
lang are not learned from; equal cosines go to the smaller code by code point; repeated
rows are judged alike; without any training row every text gets `und`. Columns besides
doc_id, text and lang are ignored, and prediction reads text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .textops import batches, column

#: Components of a vector.
DIM = 1024
#: Trigram vectors kept by a worker, and trigrams bundled at once.
CACHE, BLOCK = 16384, 8192
_kinds: dict[int, int] = {}
_letters: dict[int, np.ndarray] = {}
_grams: dict[tuple[int, int, int], np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    """The vector of a letter (0: blank), the same in every process."""
    if code not in _letters:
        _letters[code] = np.random.default_rng([7, code]).choice(np.array([-1, 1], np.int8), DIM)
    return _letters[code]


def gram(a: int, b: int, c: int) -> np.ndarray:
    if (a, b, c) not in _grams:
        if len(_grams) >= CACHE:
            _grams.clear()
        _grams[a, b, c] = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return _grams[a, b, c]


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, runs of others as 0, with a blank at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return points


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIM bundled vectors, whether the text has a letter)."""
    joined = [_codes(t or "") for t in texts]
    sizes = np.array([len(x) for x in joined])
    points = np.concatenate([np.zeros(1, np.uint32), *(y for x in joined for y in (x, np.zeros(1, np.uint32)))])
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes + 1)])
    distinct, where = np.unique(points, return_inverse=True) if points.max(initial=0) > 0xFFFF else _small_unique(points)
    for x in distinct.tolist():
        if x not in _kinds:
            _kinds[x] = x if x and chr(x).isalpha() else 0
    letters = np.array([_kinds[x] for x in distinct.tolist()], np.int64)[where]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    letters, owner = letters[keep], owner[keep]
    out = np.zeros((len(texts), DIM), np.float32)
    has = np.zeros(len(texts), bool)
    if len(letters) < 3:
        if len(letters):
            has[owner[letters != 0]] = True
        return out, has
    has[owner[letters != 0]] = True
    alphabet, rank = np.unique(letters, return_inverse=True)
    k = len(alphabet)
    code = (rank[:-2] * k + rank[1:-1]) * k + rank[2:]
    of = owner[1:-1]
    inside = letters[1:-1] != 0  # the middle letter tells the text; a blank in the middle would join two words
    code, of = code[inside], of[inside]
    if k**3 <= 1 << 22:
        there = np.zeros(k**3, bool)
        there[code] = True
        grams = np.flatnonzero(there)
        rows = np.cumsum(there)[code] - 1
    else:
        grams, rows = np.unique(code, return_inverse=True)
    for low in range(0, len(grams), BLOCK):
        part = grams[low : low + BLOCK]
        v = np.stack([gram(int(alphabet[g // (k * k)]), int(alphabet[g // k % k]), int(alphabet[g % k])) for g in part.tolist()]).astype(np.float32)
        mine = (rows >= low) & (rows < low + len(part)) if len(grams) > BLOCK else slice(None)
        counts = np.bincount(of[mine] * len(part) + rows[mine] - low, minlength=len(texts) * len(part)).reshape(len(texts), len(part)).astype(np.float32)
        out += counts @ v
    return out, has


def _small_unique(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    there = np.zeros(0x10000, bool)
    there[points] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[points]


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch, _, _ in batches(rows):
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            yield (part, *vectors(column(part, "text").to_pylist()))


def _learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for part, v, has in _parts(rows):
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.where(has[:, None] & (size > 0), v / np.maximum(size, 1e-9), 0)
        langs = np.array(column(part, "lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            total[lang] = total.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
    if total:
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "bundle": pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their prototypes (unit rows) from docs(text, lang). The driver gets one vector per language."""
    prepare(docs.sparkSession)
    parts = docs.where("lang is not null").select("text", "lang").mapInArrow(_learn, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    bundled = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("bundle"))
    rows = sorted((r.lang, r.bundle) for r in bundled.collect())
    if not rows:
        return [], np.zeros((0, DIM), np.float32)
    p = np.array([b for _, b in rows])
    return [n for n, _ in rows], (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """Rows of docs(doc_id, text, ...) with lang_pred and score in place of text; other columns stay, but for own ones of these names.

    Among equal cosines the first language by name wins.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, has in _parts(rows):
            size = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            cos = (v / size) @ prototypes.T if names else np.zeros((len(v), 1))
            best = cos.argmax(axis=1)
            known = has & bool(names)
            score = np.where(known, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).astype(float)
            label = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_pydict({c: column(part, c) for c in rest} | {"lang_pred": pa.array(label, pa.string()), "score": pa.array(score)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    return docs.select(*rest, "text").mapInArrow(run, f"{schema}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"))
    names, prototypes = train(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), names, prototypes)


QUERIES = {"op2_language_id": op2_language_id}
