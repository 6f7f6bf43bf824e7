"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from codegraph.llm.vectordup import near_duplicate_vectors, op12_embedding_dedup


def brute(ids, x, least=0.95):
    x = np.array(x, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    root = np.array(ids)
    while True:
        new = np.array([min(root[i], *root[hit[i]]) if hit[i].any() else root[i] for i in range(len(ids))])
        if (new == root).all():
            return hit, root
        root = new


def table_of(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def mixed(rng, groups, singles, d=64):
    """Groups of near copies (sizes given), and single vectors."""
    parts = [rng.normal(size=(singles, d))]
    for size in groups:
        c = rng.normal(size=d)
        parts.append(c / np.linalg.norm(c) + 0.13 * rng.normal(size=(size, d)) / np.sqrt(d))
    return np.concatenate(parts).astype(np.float32)


def answers(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"cell": 40, "split": 80, "block": 16}])
def test_groups_against_brute_force(spark, options):
    x = mixed(np.random.default_rng(1), [2, 3, 5, 9, 40, 150], 300)
    x = np.concatenate([x, x[-1:], x[-1:]])
    ids = np.random.default_rng(2).permutation(len(x)) * 3
    hit, root = brute(ids, x)
    got = answers(near_duplicate_vectors(table_of(spark, ids, x), **options))
    assert len(got) == len(x)
    assert got == {int(i): (int(hit[k].sum()), int(root[k]), bool(root[k] == i)) for k, i in enumerate(ids)}


def test_recall_of_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = rng.normal(size=a.shape)
    away -= (away * a).sum(1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9501, 0.97, size=(1500, 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * away]).astype(np.float32)
    ids = np.arange(len(x))
    hit, _ = brute(ids, x)
    got = answers(near_duplicate_vectors(table_of(spark, ids, x), cell=64))
    right = np.array([got[i][0] == hit[i].sum() for i in range(len(x))])
    print("recall of isolated pairs at 0.95 to 0.97:", right.mean())
    assert right.mean() >= 0.95
    assert all(got[i][0] <= hit[i].sum() for i in range(len(x)))


def test_query_on_the_small_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    hit, root = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    got = answers(op12_embedding_dedup(spark, "/root/testdata/sf0.001"))
    assert got == {r["vec_id"]: (int(hit[k].sum()), int(root[k]), bool(root[k] == r["vec_id"])) for k, r in enumerate(rows)}


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [1.0, inf], 1), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [3e38, 3e38], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, KEPT int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11, 12)]
    assert got == sorted([*alone, (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (9, 2, 7, False), (None, 0, None, True)], key=str)
    assert near_duplicate_vectors(df.limit(0)).collect() == []
