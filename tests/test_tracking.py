import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lawmill.functions.text import iso_date, plain_title, void_as_empty
from lawmill.operators.history import attribute_history
from lawmill.operators.snapshots import snapshot_changes

CATALOG = "snapshot string, title string, promulgated string, effective string, received_at timestamp, k1 string, change string, sid int, key string"
MANIFEST = "file string, retrieved string, loaded_at timestamp, status string, layer string, effective string, seen string, payload int, node int"
T0 = datetime(2025, 1, 1)


def changes(df, **more):
    compare = {"promulgated": iso_date(F.col("promulgated")), "effective": iso_date(F.col("effective"))}
    return snapshot_changes(df, "snapshot", plain_title(F.col("title")), compare, "received_at", "title", **more)


def catalog(spark, data):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in data], CATALOG)


def test_dates_and_titles(spark, rows):
    given = ["2020-01-02", " 2020/1/2", "20200102", "2020年1月2日", "2020.01.2", "2020-01-02 00:00:00", "", None, "　", "soon", "2020-13-1x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(iso_date(F.col("s"))).collect()]
    assert got == ["2020-01-02"] * 6 + ["", "", "", "soon", "2020-13-1x"]
    titles = spark.createDataFrame([("<em>a</em> b　c\n",), ("<b> </b>",), (None,)], "s string").select(plain_title(F.col("s")))
    assert [r[0] for r in titles.collect()] == ["abc", None, None]


def test_changes_edge_cases(spark, rows):
    data = [
        ("s1", "甲", "2020-01-01", None, T0), ("s1", "乙", "2020-01-01", "", T0), ("s1", None, "x", "x", T0), (None, "甲", "x", "x", T0),
        ("s2", " <b>甲</b>", "2020/1/1", "", T0), ("s2", "乙", "2020-01-01", None, T0), ("s2", "乙", "2020-01-02", None, T0 + timedelta(1)), ("s2", "乙", "2020-01-02", None, T0 + timedelta(1)),
        ("s2", "丙", "1", "1", None), ("s2", "丙", "2", "2", T0),
        ("s3", None, "x", "x", T0),
        ("s4", "甲", None, None, T0),
    ]
    got = rows(changes(catalog(spark, data)), "snapshot", "title", "change")
    assert got == sorted([("s2", "乙", "changed"), ("s2", "丙", "added"), ("s3", "甲", "removed"), ("s3", "乙", "removed"), ("s3", "丙", "removed"), ("s4", "甲", "added")], key=repr)
    full = {(r.snapshot, r.title): r for r in changes(catalog(spark, data)).collect()}
    assert full["s2", "乙"].was_promulgated == "2020-01-01" and full["s2", "乙"].now_promulgated == "2020-01-02"
    assert full["s2", "丙"].now_promulgated == "2" and full["s2", "丙"].was_promulgated is None
    assert rows(changes(catalog(spark, []))) == []
    assert rows(changes(catalog(spark, data[:2]))) == []


def test_changes_against_brute_force(spark, rows):
    rng = random.Random(4)
    data = [(f"s{rng.randrange(6)}", f"t{int(rng.random() ** 3 * 60)}", f"2020-01-{rng.randrange(1, 4):02d}", "", T0 + timedelta(seconds=i)) for i in range(1500)]
    state = {}
    for s, t, p, _, at in sorted(data, key=lambda r: r[4]):
        state.setdefault(s, {})[t] = p
    want, names = [], sorted(state)
    for a, b in zip(names, names[1:]):
        want += [(b, t, "added") for t in state[b].keys() - state[a].keys()] + [(b, t, "removed") for t in state[a].keys() - state[b].keys()]
        want += [(b, t, "changed") for t in state[a].keys() & state[b].keys() if state[a][t] != state[b][t]]
    for buckets in (1, 7):
        assert rows(changes(catalog(spark, data), buckets=buckets), "snapshot", "title", "change") == sorted(want, key=repr)


def history(df):
    return attribute_history(df, "file", "retrieved", "loaded_at", {"status": void_as_empty(F.col("status")), "layer": void_as_empty(F.col("layer")), "effective": iso_date(F.col("effective"))})


def manifest(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in data], MANIFEST)


def test_history_edge_cases(spark, rows):
    data = [
        ("f", "d1", T0, "a", "l", None), ("f", "d2", T0, " a　", "l ", ""), ("f", "d3", T0, "b", "l", ""), ("f", "d5", T0, "b", "l", ""), ("f", "d6", T0, "a", "l", ""),
        ("f", "d6", T0 - timedelta(1), "zzz", "l", ""), ("f", "d6", None, "zzz", "l", ""), ("f", "d6", T0, "a", "l", ""),
        ("g", "d4", T0, None, None, "2020/1/1"), ("g", "d6", T0, "", "", "2020-01-01"), (None, "d1", T0, "a", "l", ""), ("g", None, T0, "a", "l", ""),
    ]
    got = rows(history(manifest(spark, data)), "file", "valid_from", "valid_to", "status")
    assert got == sorted([("f", "d1", "d3", "a"), ("f", "d3", "d6", "b"), ("f", "d6", "9999-12-31", "a"), ("g", "d4", "9999-12-31", "")], key=repr)
    assert rows(history(manifest(spark, []))) == []


def test_history_against_brute_force(spark, rows):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.4 else f"f{rng.randrange(20)}", f"d{rng.randrange(37):02d}", T0 + timedelta(seconds=i), rng.choice("ab"), "l", "") for i in range(1200)]
    last = {}
    for f, d, _, s, _, _ in data:
        last[f, d] = s
    want = []
    for f in {k[0] for k in last}:
        runs = []
        for d in sorted(d for g, d in last if g == f):
            if not runs or runs[-1][1] != last[f, d]:
                runs.append((d, last[f, d]))
        want += [(f, a[0], b[0]) for a, b in zip(runs, [*runs[1:], ("9999-12-31", "")])]
    assert rows(history(manifest(spark, data)), "file", "valid_from", "valid_to") == sorted(want, key=repr)
