"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

Texts are lower-cased and cut into runs of letters and digits. Each benchmark item is
compared with item-sized windows of the documents: windows are placed where a document
holds a shingle of an item of that size (a window that reaches the similarity must share
one), and each gets a SimHash of 256 bits (LONGS longs) of its counted five-word shingles. The
multi-index cuts fingerprints into BLOCKS blocks of 16 bits; of two fingerprints within RADIUS
bits, one block differs in RADIUS / BLOCKS bits (rounded down) at most, so the index holds each
block of an item under all values that near, and a window is looked up by its own. Two
unrelated fingerprints meet in the index with chance about 1 in 30. Of the candidates within
the radius, those whose exact weighted (counted) shingle similarity, sum of least over sum of
greatest counts, is at least 0.8 are returned. At exactly 0.8 SimHash expects 39 differing bits,
so a few such pairs lie beyond the radius; equal word sequences are at distance 0.

Edge cases: items and documents with null text or without words match nothing; an item with
fewer than five words is one shingle, its whole sequence; a document shorter than an item is
one window; equal items each match; rows that share a doc_id but not the text are judged
each by its own text, and rows equal in both give one row; a null doc_id or item_id is
returned as null; other columns of the input, whatever their names, play no part; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table

WORDS, LONGS, RADIUS, BLOCKS = 5, 4, 47, 16
WIDTH = 64 * LONGS // BLOCKS
#: Shingles of the benchmark up to which its index is broadcast (24 bytes each); a shuffled join beyond.
BROADCAST = 1_000_000


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is evaluated once (a column alias may be inlined into each use)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def tokens(text: str) -> Column:
    return F.expr(f"transform(filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> ''), x -> xxhash64(x))")


def shingles(words: str, size: str) -> Column:
    """Hashes of the runs of `size` words (1 to 5) in the array of hashed words."""
    run = ", ".join(f"case when {size} > {k} then w[i + {k}] end" for k in range(WORDS))
    return F.expr(_let(words, "w", f"case when size(w) >= {size} then transform(sequence(0, size(w) - {size}), i -> xxhash64({size}, {run})) else array() end"))


def simhash(hashes: str) -> Column:
    """LONGS longs: bit b of long j is the sign of the sum over shingles of bit b of their j-th rehash."""
    bit = "case when aggregate(hs, 0, (n, h) -> n + case when (shiftright(h, b) & 1L) = 1L then 1 else -1 end) > 0 then shiftleft(1L, b) else 0L end"
    long = _let("transform(all, h -> xxhash64(h, j))", "hs", f"aggregate(sequence(0, 63), 0L, (out, b) -> out | {bit})")
    return F.expr(_let(hashes, "all", f"transform(sequence(0, {LONGS - 1}), j -> {long})"))


def distance(one: str, other: str) -> Column:
    return F.expr(" + ".join(f"bit_count({one}[{j}] ^ {other}[{j}])" for j in range(LONGS)))


def _blocks(print_: str) -> Column:
    """(block, bits) of the blocks of a fingerprint."""
    places = [divmod(i * WIDTH, 64) for i in range(BLOCKS)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({print_}[{j}], {at}) & {(1 << WIDTH) - 1}L").alias("bits")) for i, (j, at) in enumerate(places)))


def _near_bits() -> Column:
    """All masks of a block with RADIUS / BLOCKS bits at most: a fixed number, 137."""
    masks = ",".join(str(m) for m in range(1 << WIDTH) if m.bit_count() <= RADIUS // BLOCKS)
    return F.split(F.lit(masks), ",").cast("array<long>")


def _matches(docs: DataFrame, benchmark: DataFrame, share: int = 80) -> DataFrame:
    """(key, doc_id, start, item_id, distance, similarity, ...): windows that hold an item; key is that of the row."""
    items = benchmark.select("item_id", tokens("text").alias("words")).where("size(words) > 0")
    items = items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("size"), F.expr(f"least({WORDS}, size(words))").alias("k"), "words")
    items = items.withColumn("hashes", shingles("words", "k")).drop("words")
    items = materialise(items.withColumn("fingerprint", simhash("hashes")), "items")
    index = items.select("size", "k", F.posexplode("hashes").alias("place", "hash")).distinct()
    facts = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n"), F.collect_set("k").alias("ks")).first()
    hint = F.broadcast if facts.n <= BROADCAST else (lambda x: x)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    spots = None
    for k in sorted(facts.ks) or [WORDS]:
        own = texts.select("key", tokens("text").alias("words")).select("key", F.size("words").alias("n"), shingles("words", str(k)).alias("hashes"))
        own = own.select("key", "n", F.posexplode("hashes").alias("at", "hash")).join(hint(index.where(f"k = {k}").select("size", "place", "hash")), "hash")
        own = own.select("key", "size", F.expr("greatest(0, least(at - place, n - size))").alias("start"), F.lit(k).alias("k"))
        spots = own if spots is None else spots.unionByName(own)
    spots = spots.groupBy("key").agg(F.collect_set(F.struct("size", "start", "k")).alias("spots"))
    spots = materialise(spots, "spots")
    # Each window takes its own words along, not the document's.
    parts = F.expr(_let("words", "w", "transform(spots, s -> struct(s.size as size, s.start as start, s.k as k, slice(w, s.start + 1, s.size) as part))"))
    window = texts.dropDuplicates(["key"]).join(spots, "key").select("key", "doc_id", tokens("text").alias("words"), "spots").select("key", "doc_id", F.explode(parts).alias("s")).select("key", "doc_id", "s.*")
    window = window.withColumn("hashes", shingles("part", "k")).drop("part").withColumn("fingerprint", simhash("hashes")).withColumn("window", F.xxhash64("key", "size", "start", "k"))
    window = materialise(window, "windows")
    left = window.select("window", "size", "fingerprint", F.explode(_blocks("fingerprint")).alias("b")).select("window", "size", "fingerprint", "b.*")
    right = items.select("item", "size", F.col("fingerprint").alias("other"), F.explode(_blocks("fingerprint")).alias("b")).select("item", "size", "other", "b.*")
    right = right.withColumn("mask", F.explode(_near_bits())).withColumn("bits", F.col("bits").bitwiseXOR(F.col("mask"))).drop("mask")
    pairs = left.join(right, ["size", "block", "bits"]).withColumn("distance", distance("fingerprint", "other"))
    pairs = pairs.where(F.col("distance") <= RADIUS).select("window", "item", "distance").distinct()
    # Counted shingles of both sides meet; the greatest counts follow from the totals.
    a = window.select("window", "key", "doc_id", "start", F.size("hashes").alias("na"), F.explode("hashes").alias("hash")).groupBy("window", "key", "doc_id", "start", "na", "hash").agg(F.count("*").alias("ca"))
    b = items.select("item", "item_id", F.size("hashes").alias("nb"), F.explode("hashes").alias("hash")).groupBy("item", "item_id", "nb", "hash").agg(F.count("*").alias("cb"))
    both = pairs.join(a, "window").join(b, ["item", "hash"])
    both = both.groupBy("window", "key", "doc_id", "start", "item", "item_id", "distance").agg(F.sum(F.least("ca", "cb")).alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.where(f"100 * common >= {share} * (na + nb - common)").withColumn("similarity", F.expr("common / (na + nb - common)"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 80) -> DataFrame:
    """(doc_id, item_id, window_start, distance, similarity) at the best window, one row for each item and distinct (doc_id, text)."""
    both = _matches(docs, benchmark, share)
    best = both.groupBy("key", "doc_id", "item", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "distance")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").alias("window_start"), F.col("b.distance").alias("distance"), (-F.col("b.s")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, each judged by its own text whatever its doc_id, with all columns."""
    key, gone = fresh(docs, "key", "gone")
    found = _matches(docs, benchmark).select(F.col("key").alias(gone)).distinct()
    own = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return own.join(found, own[key] == found[gone], "left_anti").drop(key)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
