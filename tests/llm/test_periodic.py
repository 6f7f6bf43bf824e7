"""Periodic runs against brute force over all stretches."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codegraph.llm.periodic import collapse_runs, find_runs, op11_periodic_runs

SF = "/root/testdata/sf0.001"


def smallest(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def brute(x, least=24, times=3):
    """Every period's maximal stretches, kept where it is the smallest period of the stretch."""
    out, n = [], len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and smallest(x[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 14)), max_size=6))
def test_runs_against_brute_force(parts):
    x = [w for part, times in parts for w in part * times]
    assert find_runs(np.array(x, np.int64)) == brute(x)
    assert find_runs(np.array(x, np.int64), 6, 3) == brute(x, 6, 3)


def test_one_word_many_times_is_cheap():
    assert find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_many_runs_in_a_long_text(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.concatenate([np.tile(rng.integers(0, 50, 5), 7), rng.integers(0, 50, 30)]) for _ in range(30)])
    whole = find_runs(x)
    assert len(whole) >= 30 and whole == brute(x.tolist())
    monkeypatch.setattr("codegraph.llm.periodic.PROBES", 100)
    assert find_runs(x) == whole


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = next(((s, k, q) for s, k, q in sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))), (None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(kept)))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    mine = {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, SF).collect()}
    assert len(mine) == len(docs)
    short = [r for r in docs if len(r["text"] or "") < 6000]
    assert len(short) > 100 and all(mine[r["doc_id"]] == expected(r["doc_id"], r["text"]) for r in short)
    assert sum(mine[r["doc_id"]][0] > 0 for r in short) > 5


def test_edges(spark):
    line = "again and again " * 20
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a  b\tc", "x"), (5, line, "x"), (5, line, "x"), (None, line, "x"), (6, "é " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    out = {(r["doc_id"], i): r for i, r in enumerate(collapse_runs(df).collect())}
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.values()]
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 3, [], "a b c"), (5, 60, [(0, 60, 3)], "again and again"), (5, 60, [(0, 60, 3)], "again and again"), (None, 60, [(0, 60, 3)], "again and again"), (6, 50_000, [(0, 50_000, 1)], "é")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert collapse_runs(df.limit(0)).collect() == []
