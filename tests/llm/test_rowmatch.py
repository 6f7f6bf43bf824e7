"""Row pattern matching against a plain backtracking search and against SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from codegraph.llm.rowmatch import ORACLE, match_rows, op13_row_matches

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def brute(rows, greedy, gap=600):
    """rows of one key in order: (seconds, id, cents, step, goal)."""

    def fits(letter, k, a):
        t, _, c, step, goal = rows[k]
        pt, _, pc, _, _ = rows[k - 1]
        if t - pt > gap or c is None or pc is None:
            return False
        if letter == "P":
            return bool(goal) and c >= rows[a][2]
        return bool(step) and (c < pc if letter == "D" else c > pc)

    def search(a):
        """What a backtracking matcher finds from a: (last row, letters)."""
        ends, k, letters = [], a + 1, "A"
        while k < len(rows):
            if fits("P", k, a):
                ends.append((k, letters + "P"))
                if not greedy:
                    break
            letter = next((x for x in "DU" if fits(x, k, a)), None)
            if letter is None:
                break
            letters += letter
            k += 1
        return ends[-1] if ends else None

    out, a = [], 0
    while a < len(rows):
        hit = search(a) if rows[a][2] is not None else None
        if hit:
            out.append((len(out) + 1, rows[a][1], rows[hit[0]][1], hit[0] - a + 1, sum(r[2] for r in rows[a : hit[0] + 1]), hit[1]))
        a = hit[0] + 1 if hit else a + 1
    return out


def sessions(seed):
    """Keys of many sorts: short ones, and two whose rows hang together over many parts."""
    rng, keys = random.Random(seed), {}
    for key in range(40):
        n = rng.choice([1, 2, 5, 30])
        keys[key] = [(rng.choice([0.1, 0.5, 0.9]), rng.choice([0.0, 0.1]), rng.choice([3, 50])) for _ in range(n)]
    keys[100] = [(0.04, 0.0, 10_000)] * 900
    keys[101] = [(0.3, 0.002, 400)] * 900
    keys[102] = [(0.0, 0.0, 10_000)] * 300 + [(1.0, 0.0, 100)] * 20
    out = {}
    for key, rows in keys.items():
        t, made = 0, []
        for i, (goal, broken, high) in enumerate(rows):
            t += rng.choice([0, 1, 60, 600]) if rng.random() > broken else rng.choice([601, 4000])
            cents = None if rng.random() < broken / 2 else rng.randint(-high, high) + (i if key == 102 else 0)
            is_goal = rng.random() < goal
            step = None if rng.random() < broken / 2 else (is_goal or rng.random() > broken)
            made.append((t, i, cents, step, is_goal))
        out[key] = made
    return out


@pytest.mark.parametrize("greedy", [False, True])
@pytest.mark.parametrize("parts", [1, 60])
def test_against_brute_force(spark, greedy, parts):
    keys = sessions(parts)
    rows = [(key, START + timedelta(seconds=t), i, c, s, g) for key, own in keys.items() for t, i, c, s, g in own]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long, cents long, step boolean, goal boolean")
    got = sorted(tuple(r) for r in match_rows(df, greedy, parts=parts).collect())
    want = sorted((key, *m) for key, own in keys.items() for m in brute(own, greedy))
    assert got == want
    assert max(r[4] for r in got) > (30 if greedy or parts == 60 else 5)


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view clicks as select * from '{SF}/clicks.parquet'")
    cursor = c.execute(ORACLE["op13_row_matches"])
    names = [d[0] for d in cursor.description]
    got = op13_row_matches(spark, SF)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(cursor.fetchall())


def test_edges(spark):
    schema = "key long, ts timestamp_ntz, id long, cents long, step boolean, goal boolean, labels string"
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), 1, 5, None, None, "x"), (1, at(600), 2, 5, None, True, "x"), (2, at(0), 1, 5, True, True, "x"), (2, at(601), 2, 6, True, True, "x"), (3, at(0), 1, None, True, True, "x"), (3, at(1), 2, 6, True, True, "x"), (3, at(1), 2, 6, True, True, "x")]
    got = sorted(tuple(r) for r in match_rows(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, 1, 2, 2, 10, "AP"), (3, 1, 2, 2, 2, 12, "AP")]
    assert match_rows(spark.createDataFrame([], schema)).collect() == []
