"""Near-duplicate documents: HyperMinHash registers, banding, exact confirmation.

A document's set holds the 64-bit hashes of its distinct five-word shingles (words are
lower-cased in A-Z only). Each of 128 buckets keeps, for the least hash in it, the count of
leading zeros and ten mantissa bits. Equal sets form a class, and only class representatives
go on. Bands of four registers gather candidates; a pair is first judged by the
collision-corrected Jaccard estimate of its registers and then confirmed on the full sets.

No pairs within groups: each member of a band's bucket is compared with the bucket's least
member, then with the one nearest to its centre, and the confirmed links are joined to
components. What is left, members of one bucket in different components, is compared through
what sets them apart from their group's majority (see _residual), so no link is lost to the
shortcut and pairs that only share the group's common text are not formed.
A pair at similarity s shares no band with chance (1 - s^4)^32: 6e-11 at 0.85, 5e-8 at 0.8.
The estimate's slack is six standard deviations.

Edge cases: a text with fewer than five words is one shingle, its whole sequence; null texts
and texts without words have an empty set, link with nothing and stay. Repeated rows of one
doc_id are one document in links, each row returned. Ties go to the smallest doc_id. A null
doc_id links with nothing and stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, free, fresh, materialise, prepare, table
from .textops import LESS, batches, column, longs, mix, prefix, range_hash, word_hashes

WORDS, BUCKETS, ROWS, MANTISSA = 5, 128, 4, 10
#: Parts into which a join deals the rows of one group.
SALTS = 32
#: Times that documents far from their group's centre are grouped again.
LEVELS = 2
BANDS = BUCKETS // ROWS
_U = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    words, first = word_hashes(data, offs, lower=True)
    pre, out = prefix(words), []
    n = np.diff(first)
    ends = np.minimum(np.arange(len(words)) + WORDS, np.repeat(first[1:], n))
    hashes = range_hash(pre, np.arange(len(words)), ends)
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        out.append(np.unique(hashes[a : max(a + 1, b - WORDS + 1)]) if b > a else hashes[:0])
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """16-bit registers of a sorted set: leading zeros and mantissa of each bucket's least hash; 0 where the bucket is empty."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = (hashes >> _U(57)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = (hashes[at] << _U(7)) | _U(64)  # a set bit ends the zeros
        zeros = np.minimum(63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64).clip(0, 63), 62)
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
        out[bucket[at]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Buckets in which disjoint sets of sizes n and m are expected to hold equal registers."""
    a, b = n[:, None] / BUCKETS, m[:, None] / BUCKETS
    zeros = np.arange(62)[None, :]
    width = 2.0 ** (-(zeros + 1 + MANTISSA))
    low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
    rate = np.maximum(a + b, 1e-12)
    return BUCKETS * (width * a * b / rate * (np.exp(-rate * low) - np.exp(-rate * high))).sum(1)


def estimate(ra: np.ndarray, rb: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance collisions."""
    filled = ((ra > 0) | (rb > 0)).sum(1)
    same = ((ra == rb) & (ra > 0)).sum(1)
    return np.clip(same - expected_collisions(n, m), 0, None) / np.maximum(filled, 1)


def band_keys(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band that has a filled register, for rows of registers."""
    parts = r.reshape(len(r), BANDS, ROWS)
    packed = parts.astype(np.uint64) << (_U(16) * np.arange(ROWS, dtype=np.uint64))
    key = mix(packed.sum(2, dtype=np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])
    row, band = np.nonzero((parts > 0).any(2))
    return row, key[row, band]


def _sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in batches(rows, most=LESS):
        sets = shingle_sets(data, offs)
        index = np.arange(1, 1 + max((len(x) for x in sets), default=0), dtype=np.uint64)
        one = np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
        two = np.array([mix(x + index[: len(x)]).sum(dtype=np.uint64) for x in sets], np.uint64)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), longs(np.array([len(x) for x in sets])), longs(one), longs(two), pa.array([registers(x).tobytes() for x in sets], pa.binary())], names=["doc_id", "n", "one", "two", "regs"])


def _bands(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in rows:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            regs = np.frombuffer(b"".join(column(batch, "regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            row, key = band_keys(regs)
            yield pa.RecordBatch.from_arrays([longs(key), column(batch, "doc_id").take(pa.array(row)), column(batch, "n").take(pa.array(row))], names=["band", "doc_id", "n"])


def _sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in batches(rows, most=LESS):
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([x.tobytes() for x in shingle_sets(data, offs)], pa.binary())], names=["doc_id", "hashes"])


def _explode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        sets = column(batch, "hashes").to_pylist()
        own = np.repeat(np.arange(len(sets)), [len(x) // 8 for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64)), column(batch, "doc_id").take(pa.array(own))], names=["hash", "doc_id"])


def _near(share: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            n, m = (column(batch, c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            filled = np.maximum(((ra > 0) | (rb > 0)).sum(1), 1)
            goal = share / 100
            keep = estimate(ra, rb, n, m) >= goal - 6 * np.sqrt(goal * (1 - goal) / filled) - 0.01
            yield pa.RecordBatch.from_arrays([column(batch, "u"), column(batch, "v")], names=["u", "v"]).filter(pa.array(keep))

    return run


def _confirm(share: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            u, v = [], []
            for a, b, x, y in zip(*(column(batch, c) for c in ("u", "v", "su", "sv")), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= share * (len(p) + len(q) - common):
                    u.append(a.as_py())
                    v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _links(pairs: DataFrame, signed: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of at least share percent."""
    mine = signed.select("doc_id", "n", "regs")
    a = mine.toDF("u", "na", "ra")
    b = mine.toDF("v", "nb", "rb")
    likely = pairs.join(a, "u").join(b, "v").where("100 * least(na, nb) >= %d * greatest(na, nb)" % share)
    likely = materialise(likely.select("u", "v", "na", "nb", "ra", "rb").mapInArrow(_near(share), "u long, v long"), "likely")
    both = likely.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    return materialise(both.select("u", "v", "su", "sv").mapInArrow(_confirm(share), "u long, v long"), "confirmed")


def _delta(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for own, centre in zip(column(batch, "hashes"), column(batch, "centre"), strict=True):
            mine = np.frombuffer(own.as_buffer(), np.int64)
            out.append(np.setxor1d(mine, centre.values.to_numpy() if centre.is_valid else mine[:0]))
        names = ["doc_id", "g", "n", "root"]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), longs(np.array([len(x) for x in out])), pa.array(out, pa.list_(pa.int64()))], names=[*names, "d", "delta"])


def _salted(few: DataFrame) -> DataFrame:
    """Rows of few(g, ...) once for each salt: joined by g and salt, a group's rows spread over tasks."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _deltas(left: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(doc_id, g, n, root, d, delta): documents that the buckets of left connect form a group g; delta is a document's set xor the shingles of over half of its group."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    least = left.groupBy("band").agg(F.min("doc_id").alias("v"))
    group = components(left.select("band", F.col("doc_id").alias("u")).join(least, "band").select("u", "v")).toDF("doc_id", "g")
    docs = left.select("doc_id", "n", "root").distinct().join(group, "doc_id", "left").withColumn("g", F.coalesce("g", "doc_id"))
    docs = materialise(docs.join(sets, "doc_id").withColumn("salt", salt), "grouped")
    size = docs.groupBy("g").agg(F.count("*").alias("size"))
    held = docs.select(F.col("g").alias("doc_id"), "hashes").mapInArrow(_explode, "hash long, doc_id long").groupBy(F.col("doc_id").alias("g"), "hash").agg(F.count("*").alias("times")).where("times > 1")
    held = held.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    centre = held.join(_salted(size), ["g", "salt"]).where("2 * times > size").groupBy("g").agg(F.array_sort(F.collect_list("hash")).alias("centre"))
    deltas = docs.join(_salted(centre), ["g", "salt"], "left").select("doc_id", "g", "n", "root", "hashes", "centre").mapInArrow(_delta, "doc_id long, g long, n long, root long, d long, delta array<long>")
    deltas = materialise(deltas, "deltas")
    free(docs)
    return deltas


def _bare(left: DataFrame, sets: DataFrame) -> DataFrame:
    """As _deltas, of one group without a centre: delta is the set."""
    docs = left.select("doc_id", "n", "root").distinct().join(sets, "doc_id").withColumn("g", F.lit(0).cast("long")).withColumn("centre", F.lit(None).cast("array<long>"))
    return materialise(docs.select("doc_id", "g", "n", "root", "hashes", "centre").mapInArrow(_delta, "doc_id long, g long, n long, root long, d long, delta array<long>"), "deltas")


def _residual(left: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Candidates (u, v) among left(band, doc_id, n, root): all links across roots go through them.

    Documents that buckets connect form a group g; its centre holds the shingles of over half
    of its documents. With delta = set xor centre, two sets differ in |delta xor delta| shingles,
    so with w = (100 + share) * |delta| - (100 - share) * n a link needs a common part o of the
    deltas with w + w' <= 2 * (100 + share) * o. Where w + w' <= 0, both link with the group's
    document of least w. All others share an element of their deltas: sorted from rare to
    frequent, the first common one, at positions p and p', leaves o <= 1 + min(d - p, d' - p').

    Documents that a group's centre doesn't help (d > n) are grouped among themselves again,
    LEVELS times in all, and at last compared without a centre. A link's two sets differ by
    (100 - share) / share of either at most, so a document with d <= n links with such of
    d <= (200 - share) / share * n only: those up to there stay in the group too, and no link
    is lost between levels.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    deltas = None
    for level in range(LEVELS + 1):
        all_ = _deltas(left, sets, share) if level < LEVELS else _bare(left, sets)
        near = all_.where(f"{share} * d <= {200 - share} * n").withColumn("g", F.struct(F.lit(level).alias("level"), "g"))
        deltas = near if deltas is None else deltas.unionByName(near)
        far = all_.where("d > n").select("doc_id")
        if level == LEVELS or far.isEmpty():
            break
        left = materialise(left.join(far, "doc_id"), "far")
    deltas = deltas.withColumn("w", F.expr(f"{100 + share} * d - {100 - share} * n")).withColumn("salt", salt)
    star = deltas.groupBy("g").agg(F.min(F.struct("w", "doc_id", "root")).alias("star"))
    sure = deltas.join(_salted(star), ["g", "salt"]).where("root <> star.root and w + star.w <= 0").select(F.least("doc_id", "star.doc_id").alias("u"), F.greatest("doc_id", "star.doc_id").alias("v"))
    parts = deltas.select("doc_id", "g", F.explode("delta").alias("e"))
    times = materialise(parts.groupBy("g", "e").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    ranked = parts.join(times, ["g", "e"]).groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("times", "e"))).alias("parts"))
    ranked = deltas.drop("delta", "salt").join(ranked, ["doc_id", "g"]).withColumn("shared", F.size("parts"))
    # Elements that no other document holds come first; an element with too few after it for any partner is not made a row.
    useful = F.expr(f"shared - cast(greatest(0, ceil((w - {100 - share} * (n * 100 div {share} + 1)) / {2 * (100 + share)}d)) as int) + 1")
    ranked = ranked.withColumn("useful", F.least("shared", useful)).where("useful > 0")
    ranked = ranked.select("doc_id", "g", "n", "root", "w", "shared", F.expr("posexplode(slice(parts, 1, useful))").alias("p", "part")).withColumn("rest", F.expr("shared - p"))
    ranked = materialise(ranked.select("g", F.col("part.e").alias("e"), "doc_id", "n", "root", "w", "rest"), "prefixes")
    other = ranked.toDF("g", "e", "v", "m", "other", "x", "rest2")
    fits = f"doc_id < v and root <> other and 100 * least(n, m) >= {share} * greatest(n, m) and w + x > 0 and w + x <= {2 * (100 + share)} * least(rest, rest2)"
    near = ranked.join(other, ["g", "e"]).where(fits).select(F.col("doc_id").alias("u"), "v")
    return near.unionByName(sure).distinct()


def near_duplicates(docs: DataFrame, share: int = 85) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= share * union of their shingle sets.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(rows.mapInArrow(_sign, "doc_id long, n long, one long, two long, regs binary"), "signed")
    whole = signed.where("doc_id is not null and n > 0")
    classes = materialise(whole.groupBy("one", "two", "n").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("most")), "classes")
    # A row that repeats a doc_id with another text gives that doc_id two sets; both link it.
    copies = whole.join(classes.where("most > u"), ["one", "two", "n"]).where("doc_id <> u").select("u", F.col("doc_id").alias("v"))
    reps = materialise(whole.join(classes.select("one", "two", "n", F.col("u").alias("doc_id")), ["one", "two", "n", "doc_id"]).select("doc_id", "n", "regs").dropDuplicates(["doc_id"]), "reps")
    bands = materialise(reps.mapInArrow(_bands, "band long, doc_id long, n long"), "bands")
    hubs = bands.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).where("hub < most").select("band", "hub")
    hubs = materialise(hubs, "hubs")  # so that the join deals both sides anew and splits a band that many documents hold
    members = materialise(bands.join(hubs, "band"), "members")
    needed = members.select("doc_id").unionByName(members.select(F.col("hub").alias("doc_id"))).distinct()
    sets = materialise(rows.join(needed, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, hashes binary").dropDuplicates(["doc_id"]), "sets")
    first = members.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct()
    links = _links(first, reps, sets, share)
    # Buckets that still hold several components: every pair across components is compared.
    root = components(links).withColumnRenamed("u", "doc_id")
    placed = members.join(root, "doc_id", "left").select("band", "doc_id", "n", "hub", F.coalesce("root", "doc_id").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = materialise(placed.join(mixed, "band"), "left")
    # A shingle that no other document left has is in no intersection: it bounds each similarity from above.
    ids = left.select("doc_id").distinct()
    single = sets.join(ids, "doc_id").mapInArrow(_explode, "hash long, doc_id long").groupBy("hash").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id")).where("times = 1")
    single = single.groupBy("doc_id").agg(F.count("*").alias("alone"))
    keys = left.groupBy("doc_id", "n").agg(F.collect_list("band").alias("bands")).join(single, "doc_id", "left").withColumn("most", F.expr("n - coalesce(alone, 0)")).where(f"100 * most >= {share} * n")
    left = materialise(left.join(keys.select("doc_id", "bands", "most"), "doc_id"), "feasible")
    # Next the member with the fewest such shingles, the nearest to a group's centre, is compared with all of its bucket.
    centre = materialise(left.groupBy("band").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("alone"), "doc_id", "n", "most", "root")).alias("c")).select("band", "c"), "centres")
    near = left.join(centre, "band").where(f"root <> c.root and 100 * least(most, c.most) >= {share} * (n + c.n - least(most, c.most))")
    near = near.select(F.least("doc_id", "c.doc_id").alias("u"), F.greatest("doc_id", "c.doc_id").alias("v")).distinct()
    links = links.unionByName(_links(near, reps, sets, share))
    root = components(links).toDF("doc_id", "centred")
    left = left.join(root, "doc_id", "left").withColumn("root", F.coalesce("centred", "doc_id")).drop("centred")
    mixed = left.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = materialise(left.join(mixed, "band"), "residual")
    more = _links(_residual(left, sets, share), reps, sets, share)
    root = components(links.unionByName(more).unionByName(copies)).toDF("doc_id", "root")
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(root, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, share: int = 80) -> DataFrame:
    """The rows of docs, with all columns, but those with a smaller near duplicate in their group."""
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs, share).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_near_duplicates": op5_near_duplicates}
