"""Quality classifier: ordinal cumulative-link regression on hashed text.

A document's rating is quality + 1 - toxic (0, 1 or 2). One weight vector over hashed
words and word shapes gives a latent score s, ordered thresholds t0 < t1 the tail
probabilities P(rating > k) = 1 / (1 + exp(t_k - s)); their sum is the expected rating,
and a document is kept when P(rating > 1) >= 1/2.

Edge cases: a null or empty text has no features and gets the score 0 of the prior alone
(kept or not by the thresholds); labels with a null rating or without a document are
ignored; of repeated labels each counts; repeated documents are judged alike; without any
label every document is kept with null probabilities. Own columns named expected_grade, p_top or
kept are replaced by grade(), and pass keep_good(); other columns pass; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, prepare, table
from .textops import _LOWER, _SPACE, batches, column, prefix, range_hash, word_spans

#: Hash bits of a feature; labelled rows the fit may use, the least by hash of doc_id; steps of 64 rows that a fit takes, whatever its sample.
BITS, SAMPLE, STEPS = 20, 20_000, 3750
#: First step size; what a share counts against a word; rows of the sample that must set a slot.
RATE, SHARE, LEAST = 0.7, 8.0, 20
#: Bytes of the word beginnings that count as features besides the word.
STEMS = (4, 5, 6, 8)
_CLASS = np.zeros(256, np.uint8)  # shape of a byte: letter, capital, digit, other mark
_CLASS[:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
#: Slots for a document's shares: capitals, digits, marks, long words, distinct words, distinct words for the length.
_SHARES = 6
_STEPS = 10
_CODES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Per text the distinct slots it sets: its lower-cased words without marks at the ends, their beginnings, and steps of its shares."""
    starts, ends, first = word_spans(data, offs)
    size, out = 1 << BITS, []
    if not len(starts):
        return [np.zeros(0, np.int64) for _ in range(len(offs) - 1)]
    shape = _CLASS[data]
    mark = np.concatenate([[0], np.cumsum(shape == 4)])
    caps = np.concatenate([[0], np.cumsum(shape == 2)])
    digits = np.concatenate([[0], np.cumsum(shape == 3)])
    # Words go without marks at their ends, as in `word,` or `(word)***`; a word of marks alone is empty.
    plain = np.flatnonzero(shape != 4)
    after = np.append(plain, len(data))[np.searchsorted(plain, starts)]
    low = np.minimum(after, ends)
    last = np.append(plain, -1)[np.searchsorted(plain, ends) - 1]
    high = np.where(low < ends, last + 1, low)
    pre = prefix(_CODES[_LOWER[data]])
    whole = (range_hash(pre, low, high) >> np.uint64(64 - BITS)).astype(np.int64)
    slots = [whole]
    for n in STEMS:  # beginnings carry over to words that the sample doesn't hold
        stem = (range_hash(pre, low, np.minimum(low + n, high)) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - BITS)
        slots.append(np.where(high - low > n, stem.astype(np.int64), whole))
    slots = np.stack(slots, 1)
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        if a == b:
            out.append(np.zeros(0, np.int64))
            continue
        n, o, p = b - a, offs[i], offs[i + 1]
        own = np.unique(slots[a:b])
        distinct = len(np.unique(whole[a:b])) / n
        expected = min(1.0, 1 / (1 + n / 400))  # long texts repeat more
        shares = ((caps[p] - caps[o]) / (p - o) * 2, (digits[p] - digits[o]) / (p - o) * 5, (mark[p] - mark[o]) / (p - o) * 3, float(np.mean((ends[a:b] - starts[a:b]) > 12)), distinct, distinct / max(expected, distinct))
        steps = [size + k * (_STEPS + 1) + min(_STEPS, int(x * _STEPS)) for k, x in enumerate(shares)]
        out.append(np.concatenate([own, steps]))
    return out


WIDTH = (1 << BITS) + _SHARES * (_STEPS + 1)


def score(w: np.ndarray, slots: np.ndarray) -> float:
    return float(w[slots].sum(dtype=np.float64) + (SHARE - 1) * w[slots[slots >= 1 << BITS]].sum(dtype=np.float64))


def fit(indptr: np.ndarray, slots: np.ndarray, rating: np.ndarray, grades: int, steps: int = STEPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by mini-batch gradient steps; ratings weigh inversely to their share, within limits."""
    n = len(rating)
    # A slot that few rows set can't carry over to other texts. In parts, for the driver's memory.
    times = np.zeros(WIDTH, np.int32)
    for low in range(0, len(slots), 1 << 20):
        times += np.bincount(slots[low : low + (1 << 20)], minlength=WIDTH).astype(np.int32)
    keep = (times >= LEAST)[slots]
    kept = np.zeros(len(keep) + 1, np.int32)
    np.cumsum(keep, dtype=np.int32, out=kept[1:])
    indptr = kept[indptr].astype(np.int64)
    del kept
    slots = slots[keep]
    w, t = np.zeros(WIDTH), np.linspace(-2, 0, grades - 1)
    rng = np.random.default_rng(seed)
    weight = np.clip(1 / np.maximum(np.bincount(rating, minlength=grades) / max(n, 1), 1e-3) / grades, 0.4, 1.5)[rating]
    epochs = max(1, round(steps * 64 / max(n, 1)))
    for epoch in range(epochs):
        rate, order = RATE / (1 + 3 * epoch / epochs), rng.permutation(n)
        for low in range(0, n, 64):
            own = order[low : low + 64]
            sizes = indptr[own + 1] - indptr[own]
            at = np.repeat(indptr[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            row = np.repeat(np.arange(len(own)), sizes)
            slot = slots[at]
            value = np.where(slot >= 1 << BITS, SHARE, 1.0)
            s = np.bincount(row, w[slot] * value, len(own))
            above = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -30, 30)))
            wrong = (above - (rating[own][:, None] > np.arange(grades - 1))) * weight[own][:, None]
            used, inverse = np.unique(slot, return_inverse=True)
            w[used] -= rate * np.bincount(inverse, wrong.sum(1)[row] * value, len(used)) / len(own)
            t = np.sort(t + 0.1 * rate * wrong.mean(0))
    return w.astype(np.float32), t


def _extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in batches(rows):
        yield pa.RecordBatch.from_pydict({"rating": column(batch, "rating"), "slots": pa.array([x.astype(np.int32) for x in features(data, offs)], pa.list_(pa.int32()))})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on at most `sample` labelled rows, those with the least hash of doc_id; None without any."""
    prepare(docs.sparkSession)
    rating = (F.col("quality") + 1 - F.coalesce("toxic", F.lit(0))).cast("int")
    rated = labels.select(F.col("doc_id").alias("doc_id"), rating.alias("rating")).where("rating between 0 and 2")
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "rating").limit(sample)
    rows = docs.select("doc_id", "text").join(rated, "doc_id").select("doc_id", "rating", "text").mapInArrow(_extract, "rating int, slots array<int>").toArrow()
    if not rows.num_rows:
        return None
    slots = rows.column("slots").combine_chunks()
    slots = slots if isinstance(slots, pa.ListArray) else slots.chunk(0)
    indptr = slots.offsets.to_numpy().astype(np.int64)
    rating = rows.column("rating").to_numpy().astype(np.int64)
    flat = slots.flatten().to_numpy()
    del rows, slots
    indptr = indptr - indptr[0]
    # An order that does not depend on how Spark dealt the rows. Row by row, for the driver's memory.
    sizes = np.diff(indptr)
    total = np.array([flat[low:high].sum(dtype=np.int64) for low, high in zip(indptr[:-1], indptr[1:], strict=True)])
    order = np.lexsort((rating, total, sizes))
    ends = np.concatenate([[0], np.cumsum(sizes[order])])
    dealt = np.empty_like(flat)
    for k, i in enumerate(order):
        dealt[ends[k] : ends[k + 1]] = flat[indptr[i] : indptr[i + 1]]
    del flat
    return fit(ends, dealt, rating[order], 3)


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """docs with expected_grade, p_top (chance of the top rating) and kept after its own columns; own ones of these names are replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("expected_grade", "p_top", "kept")))
    w, t = model or (np.zeros(WIDTH, np.float32), np.zeros(2))
    names = docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(rows):
            s = np.array([score(w, x) for x in features(data, offs)])
            above = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -30, 30)))
            p, none = above[:, -1], np.full(len(s), model is None)
            out = [*batch.columns, pa.array(above.sum(1), mask=none), pa.array(p, mask=none), pa.array((p >= 0.5) | none)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "expected_grade", "p_top", "kept"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{own}, expected_grade double, p_top double, kept boolean")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    model = train(docs, labels)
    clash = [c for c in docs.columns if c.lower() in ("expected_grade", "p_top", "kept")]
    aside = fresh(docs, *clash)
    good = grade(docs.withColumnsRenamed(dict(zip(clash, aside, strict=True))), model).where("kept").drop("expected_grade", "p_top", "kept")
    return good.withColumnsRenamed(dict(zip(aside, clash, strict=True))).select(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
