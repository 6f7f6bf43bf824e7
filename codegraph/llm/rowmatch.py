"""Row pattern matching: A (D|U)*? P, or its greedy form, over each key's rows in order.

Rows are dealt out by ranges of (key, ts, id), so that a hot key spreads over many parts, and each
part is scanned backwards with a monotonic stack: the nearest goal at least as high as a row
answers the reluctant form, a binary search over the suffix-maximum records of the goals the
greedy one. A row that no match can go through or end at, seen from the row before it, is a break;
between two breaks of one part all is settled there. What lies before a part's first break (head),
after its last (tail), or all of a part without any (whole) waits for its neighbours, as one row
of packed arrays a piece.

Pieces are settled by parts, not by rows. Each says which highest goals can be met from its left
(records) and whether a match may run through it; doubling over part numbers gives the highest goal
to the right of each part and finds the part where a match that leaves its own comes to its goal.
A piece may be entered at its start or behind one of its records; each entry leads to an entry of
a later part, and doubling over these links marks the entries that the search really takes. Then
each piece is walked from its own entry, and matches over several parts are put together.

What one task holds is a part (ROWS rows on average) or a piece of it; joins are on part numbers; a
match's letters are one text, as long as the match. The driver sees counts only. Parts are numbered
by Spark's range partitioning, which leaves none but the last empty; a gap raises an error.

Edge cases: rows with a null key or ts must be dropped before; a null id sorts first; null cents fit no letter;
null step or goal count as false; rows equal in key, ts and id go by cents, step, goal; an empty
table gives an empty table. Columns besides the six named are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, materialise, prepare, table
from .textops import column, longs

#: Rows of a part, on average; microseconds that a row may come after the one before it.
ROWS, GAP = 1 << 18, 600_000_000
HEAD, WHOLE, TAIL = 0, 1, 2
_HAS, _STEP, _GOAL = 1, 2, 4
_MATCH = "key long, part int, pos long, first_id long, last_id long, total long, labels string"
_PIECE = "side int, last_ts long, last_cents long, packed binary"
_ORDER = ("key", "ts", "id", "cents", "step", "goal")


def answers(cents: list[int], through: list[bool], goal: list[bool], greedy: bool) -> list[int]:
    """For each row the row of its P, or -1: goals after it, at least as high, reached by rows that may be passed through."""
    out, keys, at = [-1] * len(cents), [], []
    for i in range(len(cents) - 1, -1, -1):
        x = cents[i]
        if keys:
            if greedy:  # keys rise from the last goal backwards
                k = bisect_left(keys, x)
                if k < len(keys):
                    out[i] = at[k]
            else:  # keys are negative and rise towards the nearest goal
                k = bisect_right(keys, -x)
                if k:
                    out[i] = at[k - 1]
        if not through[i]:
            keys.clear()
            at.clear()
        if goal[i]:
            if not greedy:
                while keys and keys[-1] >= -x:
                    keys.pop()
                    at.pop()
                keys.append(-x)
                at.append(i)
            elif not keys or x > keys[-1]:
                keys.append(x)
                at.append(i)
    return out


class Rows:
    """Arrays of consecutive rows, and which of them fit a letter after the row before."""

    def __init__(self, ts: np.ndarray, ids: np.ndarray, cents: np.ndarray, marks: np.ndarray, gap: int, before: tuple[int, int] | None, same: np.ndarray | None = None) -> None:
        self.ts, self.ids, self.cents, self.marks = ts, ids, cents, marks
        has = marks & _HAS > 0
        lead = before or (0, 0)
        pts, pcents = np.concatenate([[lead[0]], ts[:-1]]), np.concatenate([[lead[1]], cents[:-1]])
        near = has & np.concatenate([[before is not None], has[:-1]]) & (ts - pts <= gap)
        if same is not None:
            near &= same
        self.has = has
        self.through = near & (marks & _STEP > 0) & (cents != pcents)
        self.goal = near & (marks & _GOAL > 0)
        self.letters = np.where(cents > pcents, ord("U"), ord("D")).astype(np.uint8).tobytes()
        self.sums = np.concatenate([[0], np.cumsum(np.where(has, cents, 0))])

    @classmethod
    def packed(cls, data: bytes, gap: int, before: tuple[int, int] | None) -> Rows:
        return cls(*np.frombuffer(data, np.int64).reshape(4, -1), gap, before)

    def pack(self, low: int, high: int) -> bytes:
        return np.stack([x[low:high].astype(np.int64) for x in (self.ts, self.ids, self.cents, self.marks)]).tobytes()

    def answers(self, greedy: bool) -> list[int]:
        return answers(self.cents.tolist(), self.through.tolist(), self.goal.tolist(), greedy)

    def records(self, greedy: bool) -> tuple[np.ndarray, np.ndarray]:
        """(cents, row) of the goals that a match from the left can end at: each higher than all before it (greedy: than all after it)."""
        blocked = np.flatnonzero(~self.through)
        reach = np.flatnonzero(self.goal[: int(blocked[0]) + 1 if len(blocked) else None])
        values = self.cents[reach]
        if greedy:
            values, reach = values[::-1], reach[::-1]
        best = np.maximum.accumulate(values) if len(values) else values
        keep = np.concatenate([[True], values[1:] > best[:-1]]) if len(values) else np.zeros(0, bool)
        return values[keep], reach[keep]


def _walk(nxt: list[int], low: int, high: int) -> Iterator[tuple[int, int]]:
    while low < high:
        j = nxt[low]
        if j < 0:
            low += 1
        else:
            yield low, j
            low = j + 1


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names=names)


_MATCH_NAMES = ["key", "part", "pos", "first_id", "last_id", "total", "labels"]
_MATCH_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _match(r: Rows, key: int, part: int, base: int, i: int, j: int) -> tuple:
    return key, part, base + i, int(r.ids[i]), int(r.ids[j]), int(r.sums[j + 1] - r.sums[i]), "A" + r.letters[i + 1 : j].decode() + "P"


def _scan(gap: int, greedy: bool) -> Callable:
    names = [*_MATCH_NAMES, "side", "last_ts", "last_cents", "packed"]
    types = [*_MATCH_TYPES, pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        t = pa.Table.from_batches(whole).combine_chunks()
        part = TaskContext.get().partitionId()
        key = t.column("key").to_numpy()
        ids = t.column("id").fill_null(0).to_numpy()
        marks = np.zeros(t.num_rows, np.int64)
        for bit, name in ((_STEP, "step"), (_GOAL, "goal")):
            marks |= bit * t.column(name).fill_null(False).to_numpy().astype(np.int64)
        marks |= _HAS * t.column("cents").is_valid().to_numpy().astype(np.int64)
        cents = t.column("cents").fill_null(0).to_numpy()
        ts = t.column("ts").cast(pa.int64()).to_numpy()
        r = Rows(ts, ids, cents, marks, gap, None, np.concatenate([[False], key[1:] == key[:-1]]))
        linked = r.through | r.goal
        # Of the first row only what it says itself is known here.
        linked[0] = bool(part and marks[0] & _HAS and marks[0] & (_STEP | _GOAL))
        breaks = np.flatnonzero(~linked)
        n = len(key)
        out = []

        def piece(side: int, low: int, high: int) -> None:
            last = int(r.cents[high - 1]) if r.has[high - 1] else None
            out.append((int(key[low]), part, low, None, None, None, None, side, int(ts[high - 1]), last, r.pack(low, high)))

        if not len(breaks):
            piece(WHOLE, 0, n)
        else:
            low, high = int(breaks[0]), int(breaks[-1])
            if low:
                piece(HEAD, 0, low)
            piece(TAIL, high, n)
            nxt = r.answers(greedy) if high > low else []
            out += [(*_match(r, int(key[i]), part, 0, i, j), None, None, None, None) for i, j in _walk(nxt, low, high)]
        for i in range(0, len(out), 5000):
            yield _batch(out[i : i + 5000], names, types)

    return run


def _pieces(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[tuple[dict, Rows]]:
    for batch in batches:
        for row in batch.to_pylist():
            seam = row["side"] != TAIL and row["before_key"] == row["key"] and row["before_cents"] is not None
            yield row, Rows.packed(row["packed"], gap, (row["before_ts"], row["before_cents"]) if seam else None)


def _leads(gap: int, greedy: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, r in _pieces(batches, gap):
            values, at = r.records(greedy)
            out = (row["node"], row["part"], int(values.max()) if len(values) else None, bool(row["side"] == WHOLE and r.through.all()), values.tolist(), at.tolist())
            yield _batch([out], ["node", "part", "lead", "open", "values", "at"], [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())])

    return run


def _exits(gap: int, greedy: bool) -> Callable:
    """Where a search that enters a piece at an entry leaves it: at a row whose P lies further right (x: its cents), or at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, r in _pieces(batches, gap):
            n, most = len(r.ids), row["most"]
            root = not (r.through[0] or r.goal[0])
            entries = [0] if root else [0, *(int(i) + 1 for i in r.records(greedy)[1])]
            blocked = np.flatnonzero(~r.through)
            crossing = (r.has & (r.cents <= most)) if most is not None else np.zeros(n, bool)
            crossing[: int(blocked[-1]) if len(blocked) else 0] = False
            nxt = r.answers(greedy)
            goes, ends = crossing.tolist(), [n] * (n + 1)
            for i in range(n - 1, -1, -1):
                if goes[i] and (greedy or nxt[i] < 0):
                    ends[i] = i
                else:
                    ends[i] = ends[nxt[i] + 1 if nxt[i] >= 0 else i + 1]
            out = [(row["node"], row["part"], e, root, *((ends[e], int(r.cents[ends[e]])) if ends[e] < n else (None, None))) for e in sorted({*entries})]
            yield _batch(out, ["node", "part", "entry", "root", "leaves", "x"], [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()])

    return run


def _goals(greedy: bool) -> Callable:
    """The goal of each search among the records of the part it came to."""

    def run(searches: pa.Table, records: pa.Table) -> pa.Table:
        x = searches.column("x").to_numpy()
        at = np.zeros(0, np.int64)
        if len(x):
            values, rows = (np.array(records.column(c)[0].as_py(), np.int64) for c in ("values", "at"))
            at = rows[np.searchsorted(values, x)]  # values rise, from the left or (greedy) from the right
        return pa.table({"node": searches.column("node"), "entry": searches.column("entry"), "root": searches.column("root"), "leaves": searches.column("leaves"), "ends_in": searches.column("q"), "ends_at": longs(at)})

    return run


def _walked(gap: int, greedy: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, r in _pieces(batches, gap):
            high = len(r.ids) if row["leaves"] is None else row["leaves"]
            found = [_match(r, row["key"], row["part"], row["pos"], i, j) for i, j in _walk(r.answers(greedy), row["entry"], high)]
            for i in range(0, len(found), 5000):
                yield _batch(found[i : i + 5000], _MATCH_NAMES, _MATCH_TYPES)

    return run


def _shares(gap: int) -> Callable:
    """Of a match over several parts, the share of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, r in _pieces(batches, gap):
            first, last = row["node"] == row["start"], row["part"] == row["ends_in"]
            low, high = row["leaves"] if first else 0, row["ends_at"] + 1 if last else len(r.ids)
            letters = bytearray(r.letters[low:high])
            if first:
                letters[0] = ord("A")
            if last:
                letters[-1] = ord("P")
            out = (row["start"], row["key"], row["part"], row["pos"] + low, int(r.ids[low]), int(r.ids[high - 1]), int(r.sums[high] - r.sums[low]), letters.decode())
            yield _batch([out], ["start", *_MATCH_NAMES], [pa.int64(), *_MATCH_TYPES])

    return run


def _reaches(lead: DataFrame, written: list[DataFrame]) -> list[DataFrame]:
    """(part, m, open) for 1, 2, 4, ... parts to the right: the highest goal in them, up to the first that no match runs through; whether all are run through."""
    out = [materialise(lead, "reach")]
    while not out[-1].where("open").isEmpty():
        far = out[-1].select((F.col("part") - (1 << len(out) - 1)).alias("part"), F.col("m").alias("m2"), F.col("open").alias("open2"))
        both = out[-1].join(far, "part", "left")
        out.append(materialise(both.select("part", F.when(F.col("open"), F.greatest("m", "m2")).otherwise(F.col("m")).alias("m"), (F.col("open") & F.coalesce("open2", F.lit(False))).alias("open")), "reach"))
    written += out
    return out


def _targets(searches: DataFrame, reaches: list[DataFrame], greedy: bool) -> DataFrame:
    """searches with q, the part that holds the goal of x: the first with one, or (greedy) the last."""
    searches = searches.withColumn("q", F.col("part"))
    for k in range(len(reaches) - 1, -1, -1):
        step = reaches[k].select(F.col("part").alias("q"), "m", "open")
        searches = searches.join(step, "q", "left")
        if greedy:
            beyond = reaches[-1].select((F.col("part") - (1 << k)).alias("q"), F.col("m").alias("rest"))
            searches = searches.join(beyond, "q", "left")
            on = F.coalesce(F.col("open") & (F.col("rest") >= F.col("x")), F.lit(False))
        else:
            on = F.coalesce(F.col("m") < F.col("x"), F.lit(True))
        searches = searches.withColumn("q", F.when(on, F.col("q") + (1 << k)).otherwise(F.col("q"))).drop("m", "open", "rest")
    return searches.withColumn("q", F.col("q") + 1)


def _taken(edges: DataFrame, written: list[DataFrame]) -> DataFrame:
    """(node, entry) that the searches really take: all that roots lead to, by doubling."""
    real, jump, count = edges.where("root").select("node", "entry"), edges.select("node", "entry", "to_node", "to_entry"), -1
    while True:
        new = real.join(jump, ["node", "entry"]).select(F.col("to_node").alias("node"), F.col("to_entry").alias("entry"))
        real = materialise(real.unionByName(new).distinct(), "taken")
        written.append(real)
        before, count = count, real.count()
        if count == before:
            return real
        far = jump.select(F.col("node").alias("to_node"), F.col("entry").alias("to_entry"), F.col("to_node").alias("node2"), F.col("to_entry").alias("entry2"))
        jump = materialise(jump.join(far, ["to_node", "to_entry"]).select("node", "entry", F.col("node2").alias("to_node"), F.col("entry2").alias("to_entry")), "jump")
        written.append(jump)


def match_rows(rows: DataFrame, greedy: bool = False, gap: int = GAP, parts: int | None = None) -> DataFrame:
    """(key, match_no, first_id, last_id, n_rows, total, labels) per match in rows(key, ts, id, cents, step, goal).

    A is any row with cents; D and U are rows with step, below and above the row before; P has goal
    and at least A's cents; D, U, P come at most `gap` microseconds after the row before. The search
    starts at a key's first row, moves one row on without a match, and goes on after a match's last row.
    """
    prepare(rows.sparkSession)
    parts = parts or max(1, math.ceil(rows.count() / ROWS))
    dealt = rows.select(*_ORDER).repartitionByRange(parts, "key", "ts", "id").sortWithinPartitions(*_ORDER)
    found = materialise(dealt.mapInArrow(_scan(gap, greedy), f"{_MATCH}, {_PIECE}"), "matches")
    settled = found.where("side is null").select(*_MATCH_NAMES)
    # Pieces with the last row of the part before.
    pieces = found.where("side is not null").select("key", "part", "pos", "side", "last_ts", "last_cents", "packed")
    ends = pieces.where(F.col("side") != HEAD).select((F.col("part") + 1).alias("part"), F.col("key").alias("before_key"), F.col("last_ts").alias("before_ts"), F.col("last_cents").alias("before_cents"))
    pieces = pieces.join(ends, "part", "left").withColumn("node", 2 * F.col("part").cast("long") + (F.col("side") == TAIL).cast("long"))
    gone = (F.col("part") > 0) & F.col("before_key").isNull() & (F.col("side") != TAIL)
    pieces = pieces.withColumn("key", F.when(gone, F.raise_error(F.lit("a part without rows between others")).cast("long")).otherwise(F.col("key"))).drop("last_ts", "last_cents")
    written: list[DataFrame] = []
    leads = materialise(pieces.where(F.col("side") != TAIL).mapInArrow(_leads(gap, greedy), "node long, part int, lead long, open boolean, values array<long>, at array<long>"), "leads")
    reaches = _reaches(leads.select((F.col("part") - 1).alias("part"), F.col("lead").alias("m"), "open"), written)
    most = reaches[-1].select("part", F.col("m").alias("most"))
    exits = pieces.where(F.col("side") != HEAD).join(most, "part", "left").mapInArrow(_exits(gap, greedy), "node long, part int, entry long, root boolean, leaves long, x long")
    exits = materialise(exits, "exits")
    searches = _targets(exits.where("x is not null"), reaches, greedy).groupBy("q")
    goals = searches.cogroup(leads.withColumnRenamed("part", "q").groupBy("q")).applyInArrow(_goals(greedy), "node long, entry long, root boolean, leaves long, ends_in int, ends_at long")
    on = goals.withColumn("to_node", 2 * F.col("ends_in").cast("long")).withColumn("to_entry", F.col("ends_at") + 1)
    none = F.lit(None)
    over = exits.where("x is null").select("node", "entry", "root", none.cast("long").alias("leaves"), none.cast("int").alias("ends_in"), none.cast("long").alias("ends_at"), (2 * (F.col("part").cast("long") + 1)).alias("to_node"), F.lit(0).cast("long").alias("to_entry"))
    edges = materialise(on.unionByName(over), "edges")
    told = materialise(_taken(edges, written).join(edges.drop("root"), ["node", "entry"], "left"), "told")
    free(*written, exits, edges, leads)
    walked = pieces.join(told.select("node", "entry", "leaves"), "node").mapInArrow(_walked(gap, greedy), _MATCH)
    spans = told.where("leaves is not null").select(F.col("node").alias("start"), "leaves", "ends_in", "ends_at", F.explode(F.sequence(F.expr("cast(node div 2 as int)"), "ends_in")).alias("at"))
    spans = spans.withColumn("node", F.when(F.expr("at = start div 2"), F.col("start")).otherwise(2 * F.col("at").cast("long"))).drop("at")
    shares = pieces.join(spans, "node").mapInArrow(_shares(gap), f"start long, {_MATCH}").groupBy("start")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "labels"))), lambda s: s["labels"]), "")
    crossing = shares.agg(F.min("key").alias("key"), F.min("part").alias("first"), F.min_by("pos", "part").alias("pos"), F.min_by("first_id", "part").alias("first_id"), F.max_by("last_id", "part").alias("last_id"), F.sum("total").alias("total"), letters.alias("labels"))
    crossing = crossing.withColumnRenamed("first", "part").select(*_MATCH_NAMES)
    return _numbered(settled.unionByName(walked).unionByName(crossing))


def _numbered(matches: DataFrame) -> DataFrame:
    """Matches with their number in the key: the number in the part, and what the key's parts before hold."""
    matches = materialise(matches, "all-matches")
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = matches.groupBy("key", "part").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(before)).where("before > 0").select("key", "part", "before")
    own = matches.withColumn("no", F.row_number().over(W.partitionBy("key", "part").orderBy("pos")))
    own = own.join(counts, ["key", "part"], "left").withColumn("match_no", F.col("no") + F.coalesce("before", F.lit(0)))
    return own.select("key", F.col("match_no").cast("long").alias("match_no"), "first_id", "last_id", F.length("labels").cast("long").alias("n_rows"), "total", "labels")


def op13_row_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    parts = max(1, math.ceil(clicks.count() / ROWS))
    rows = clicks.where("client_id is not null and ts is not null").distinct()
    value = F.col("value")
    cents = F.when(~F.isnan(value) & (F.abs(value) < 9e13), F.floor(100 * value + 0.5))  # beyond it lie no cents
    rows = rows.select(F.col("client_id").alias("key"), "ts", F.col("click_id").alias("id"), cents.cast("long").alias("cents"), (F.col("kind") != "error").alias("step"), (F.col("kind") == "purchase").alias("goal"))
    found = match_rows(rows, parts=parts)
    return found.select(F.col("key").alias("client_id"), "match_no", "first_id", "last_id", "n_rows", F.col("total").alias("sum_cents"), F.sha2("labels", 256).alias("labels_sha256"))


QUERIES = {"op13_row_matches": op13_row_matches}

ORACLE = {
    "op13_row_matches": """
with recursive d as (select distinct * from clicks where client_id is not null and ts is not null),
c as (select client_id, ts, click_id, kind, cast(floor(100 * value + 0.5) as bigint) cents from d),
r as (select *, row_number() over w n, lag(cents) over w pc, ts - lag(ts) over w <= interval 10 minutes near from c window w as (partition by client_id order by ts, click_id)),
f as (select *, case when near and kind is not null and kind <> 'error' and cents < pc then 'D' when near and kind is not null and kind <> 'error' and cents > pc then 'U' end l, coalesce(near and kind = 'purchase' and cents is not null and pc is not null, false) goal from r),
g as (select *, sum(case when l is null then 1 else 0 end) over (partition by client_id order by n) run from f),
p as (select a.client_id, a.n i, min(b.n) j from g a join g b on a.client_id = b.client_id and b.goal and b.n > a.n and b.cents >= a.cents and (b.run = a.run or b.run = a.run + 1 and b.l is null) group by 1, 2),
s as (select p.client_id, p.i, p.j, min(q.i) nx from p asof join p q on p.client_id = q.client_id and q.i > p.j group by 1, 2, 3
      union all select p.client_id, p.i, p.j, null from p where not exists (select 1 from p q where q.client_id = p.client_id and q.i > p.j)),
m as (select client_id, min(i) i, 1 match_no from p group by 1
      union all select s.client_id, s.nx, m.match_no + 1 from m join s on s.client_id = m.client_id and s.i = m.i where s.nx is not null)
select m.client_id, cast(m.match_no as bigint) match_no, min_by(g.click_id, g.n) first_id, max_by(g.click_id, g.n) last_id, count(*) n_rows, cast(sum(g.cents) as bigint) sum_cents,
       sha256(string_agg(case when g.n = s.i then 'A' when g.n = s.j then 'P' else g.l end, '' order by g.n)) labels_sha256
from m join s on s.client_id = m.client_id and s.i = m.i join g on g.client_id = m.client_id and g.n between s.i and s.j group by 1, 2
""",
}
