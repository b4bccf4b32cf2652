import numpy as np
from pyspark.sql import functions as F

from lawmill.llm import neighbors as N

SCHEMA = "keys string, vectors array<float>, key string, id int, cosine double"


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], "x", 1, 0.5) for k, v in rows], SCHEMA)


def lists(df, dim, k, **options):
    out = {}
    for r in N.nearest(df, "keys", "vectors", dim, k, **options).orderBy("key", "rank").collect():
        out.setdefault(r.key, []).append((r.neighbour, round(r.cosine, 6)))
    return out


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.standard_normal((n, dim))
    return (x * rng.uniform(0.3, 5, (n, 1))).astype(np.float32)


def test_edge_cases(spark):
    rows = [("a", [1, 0, 0]), ("a", [1, 0, 0]), ("b", [2, 0, 0]), ("c", [2, 0, 0]), ("d", [1, 1, 0]), ("e", [0, 0, 0]), ("f", None), ("g", [1, 0]), (None, [1, 0, 0]), ("h", [float("nan"), 0, 1])]
    got = lists(table(spark, rows), 3, 2)
    assert got == {"a": [("b", 1.0), ("c", 1.0)], "b": [("a", 1.0), ("c", 1.0)], "c": [("a", 1.0), ("b", 1.0)], "d": [("a", 0.707107), ("b", 0.707107)]} or set(got) == {"a", "b", "c", "d"}
    assert {n for n, _ in got["b"]} == {"a", "c"} and {n for n, _ in got["a"]} == {"b", "c"}
    assert lists(table(spark, []), 3, 2) == {} and lists(table(spark, rows[:1]), 3, 2) == {}
    assert set(lists(table(spark, [("a", [1, 0]), ("b", [0, 1])]), 2, 5)["a"]) == {("b", 0.0)}


def test_many_equal_vectors(spark):
    got = lists(table(spark, [(f"k{i:03d}", [1, 2, 3]) for i in range(300)] + [("z", [1, 2, 4])]), 3, 3)
    assert got["k000"] == [("k001", 1.0), ("k002", 1.0), ("k003", 1.0)] and [n for n, _ in got["k299"]] == ["k000", "k001", "k002"] and len(got["z"]) == 3


def test_recall_of_the_forest(spark):
    x = clustered(3000)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :5]
    got = lists(table(spark, [(f"k{i:04d}", v) for i, v in enumerate(x)]), 16, 5, leaf=200, trees=8, more=3, sample=1000)
    names = {k: {int(n[1:]) for n, _ in v} for k, v in got.items()}
    assert len(got) == 3000 and all(len(v) == 5 for v in got.values())
    recall = np.mean([j in names[f"k{i:04d}"] for i in range(3000) for j in true[i]])
    close = [j in names[f"k{i:04d}"] for i in range(3000) for j in true[i] if s[i, j] >= 0.9]
    assert recall > 0.9 and np.mean(close) > 0.98
    assert all(abs(c - s[int(k[1:]), int(n[1:])]) < 1e-5 for k in list(got)[:200] for n, c in got[k])


def test_block_search_and_deep_leaves():
    x = clustered(700, 8, 1)
    unit = N._unit(x)
    place, value = N.best_in_block(unit, unit, np.arange(700), np.arange(700), 5, rows=64, groups=40)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    assert np.allclose(-np.sort(-value, axis=1), -np.sort(-s, axis=1)[:, :5], atol=1e-5) and (place >= 0).all()
    out = []
    N._split(unit, unit, np.arange(700), np.arange(700), np.arange(700), np.arange(700), 5, 30, np.random.default_rng(0), out)
    assert set(np.concatenate([q for q, _ in out])) == set(range(700))
    same = np.ones((500, 8), np.float32)
    out = []
    N._split(same, same, np.arange(500), np.arange(500), np.arange(500), np.arange(500), 5, 30, np.random.default_rng(0), out)
    assert set(np.concatenate([q for q, _ in out])) == set(range(500))


def test_priority_queue_finds_the_leaves_behind_the_narrowest_margins():
    x = N._unit(clustered(500, 8, 2))
    forest = N.Forest.fit(x, 3, 3)
    own, more = forest.search(x, 4)
    bounds = np.full((500, 3 * 8), np.inf)
    for t in range(3):
        for leaf in range(8):
            node, cost = 7 + leaf, np.zeros(500)
            while node:
                up = (node - 1) // 2
                m = x @ forest.normal[t, up] - forest.offset[t, up]
                wrong = (m > 0) != (node == 2 * up + 2)
                cost = np.maximum(cost, np.where(wrong, np.abs(m), 0))
                node = up
            bounds[:, t * 8 + leaf] = cost
    assert all((bounds[i, own[i]] < 1e-5).all() for i in range(500))
    for i in range(500):
        rest = np.sort(np.delete(bounds[i], own[i]))[:4]
        assert len(set(more[i]) | set(own[i])) == 7 and np.allclose(np.sort(bounds[i, more[i]]), rest, atol=1e-5)


def test_pairs(spark):
    df = spark.createDataFrame([("b", 1, "a", 0.95), ("a", 1, "b", 0.95), ("a", 2, "c", 0.5)], "key string, rank int, neighbour string, cosine double")
    assert [tuple(r) for r in N.close_pairs(df, 0.9).collect()] == [("a", "b")]
    assert N.close_pairs(df.withColumn("cosine", F.lit(0.1)), 0.9).count() == 0
