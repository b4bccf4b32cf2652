import numpy as np
import pytest
from pyspark.sql import functions as F

from lawmill.operators import listing as L
from lawmill.sources.embedding import embedded, embedding_text, resumed


def test_select_and_search(spark, rows):
    df = spark.createDataFrame([("甲保护法", "行政法", "current", "某市"), ("乙法", "行政法规", None, None), ("丙保护法", None, "historical", "x"), (None, None, "current", None)], "title string, category string, layer string, issuer string")
    assert rows(L.select_laws(df), "title") == sorted([("甲保护法",), ("乙法",), (None,)], key=repr)
    assert rows(L.select_laws(df, ("current", "historical"), "中华人民共和国保护"), "title") == [("丙保护法",), ("甲保护法",)]
    assert rows(L.select_laws(df, category="法规"), "title") == [("乙法",)]
    assert rows(L.metadata_search(df, ["行政", "某市"]), "title") == [("甲保护法",)] and L.metadata_search(df, []).count() == 4
    assert [r[0] for r in df.select(L.category_position(F.col("category"))).collect()] == [3, 13, 99, 99]


def test_parts_and_supplements(spark, rows):
    df = spark.createDataFrame([("k", "a", "1"), ("k", "b", "2"), ("k", "b", "3"), ("j", "a", "1"), ("j", "b", None)], "k string, p string, t string")
    assert rows(L.merged_parts(df, "k", "p", "t", ["b", "a"])) == [("k", "## b\n\n2\n\n## a\n\n1")]
    a = spark.createDataFrame([("甲乙丙丁",), ("乙丙",), ("戊",), ("",), (None,), ("同",)], "key string")
    b = spark.createDataFrame([("乙丙丁", "p2"), ("甲乙丙丁戊", "p1"), ("同", "p9"), ("同", "p3"), ("", "p0")], "key string, path string")
    assert rows(L.supplement(a, b)) == sorted([("甲乙丙丁", "p1", "held"), ("乙丙", "p1", "held"), ("戊", "p1", "held"), ("同", "p3", "exact")], key=repr)
    assert L.supplement(a.limit(0), b).count() == 0 and L.supplement(a, b.limit(0)).count() == 0


def test_rewrite_lists(spark):
    given = ['```json\n["a", " b ", ""]\n```', 'so: ["x"] done', "1. 甲；2、乙\n\n- 丙", "[1, 2]", '["broken', "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, s string").orderBy("i")
    got = [r[0] for r in df.select(L.rewrite_list(F.col("s"), 2)).collect()]
    assert got == [["a", "b"], ["x"], ["甲", "乙"], ["1", "2"], ["[\"broken"], [], []]


def test_fresh(spark, rows):
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-08",), (None,)], "d string").withColumn("t", F.to_timestamp("d"))
    assert rows(L.fresh(df, "t", F.to_timestamp(F.lit("2026-01-09")), 7), "d") == [("2026-01-08",)]


def test_embedding_and_resuming(spark, rows):
    def toy(texts):
        return np.array([[len(t), 1.0] for t in texts])

    clauses = spark.createDataFrame([("a", "1", "xx"), ("b", "2", None), ("c", "3", "y")], "key string, hash string, text string")
    index = spark.createDataFrame([("a", "1", [9.0, 9.0]), ("b", "old", [8.0, 8.0]), ("z", "1", [7.0, 7.0])], "key string, hash string, vec array<float>")
    assert rows(resumed(clauses, index, toy), "key", "hash", "vec") == [("a", "1", [9.0, 9.0]), ("b", "2", [0.0, 1.0]), ("c", "3", [1.0, 1.0])]
    with pytest.raises(Exception, match="another number"):
        embedded(clauses, lambda texts: toy(texts)[:0]).collect()
    parts = spark.createDataFrame([("k", "t", None, "c", "b ")], "key string, title string, article string, chapter string, body string")
    assert rows(embedding_text(parts)) == [("k", "t  c b")]


def test_staged_tables_and_spreading(spark, rows):
    from pathlib import Path

    from lawmill.session import clear_staged, shared_dir, spread, staged

    df = staged(spark.range(10), "t")
    assert df.count() == 10
    few = spread(spark.range(0, 10, 1, 1))
    assert few.rdd.getNumPartitions() >= 4 and rows(few) == rows(df)
    shuffled = df.groupBy("id").count()
    assert spread(shuffled) is shuffled
    at = Path(shared_dir(spark).removeprefix("file://")) / f"lawmill-{spark.sparkContext.applicationId}"
    assert at.exists()
    clear_staged(spark)
    assert not at.exists()


def test_groups_checklist_and_source_tree(spark, rows):
    codes = spark.createDataFrame([(210,), (350,), (310,), (110,), (None,)], "c int")
    got = [tuple(r) for r in codes.select("c", L.group_of(F.col("c")).alias("g"), L.group_position(L.group_of(F.col("c"))).alias("p")).collect()]
    assert got == [(210, "行政法规", 2), (350, "司法解释", 3), (310, "地方法规", 4), (110, "法律语料", 1), (None, "法律语料", 1)]
    r = [("宪法", "宪法", "a ", None, 3, None), ("宪法修正案", "宪法", None, None, 3, "x"), ("某法", None, None, None, 9, None), ("乙法", "法律", None, None, None, None)]
    df = spark.createDataFrame(r, "title string, category string, promulgated string, effective string, status_code int, issuer string")
    assert rows(L.checklist(df, {3: "有效"}), "title", "promulgated", "status") == sorted([("宪法修正案", "", "有效"), ("某法", "", "未知(9)"), ("乙法", "", "未知(None)")], key=repr)
    nodes = [("法/甲法(2001-02-03).md", "blob", 5), ("法/乙法（2004年）.md", "blob", None), ("法/_x.md", "blob", 1), ("法/a/丙.md", "blob", 1), ("他/丁.md", "blob", 1), ("法/戊", "tree", 1), ("法/中华人民共和国己法.md", "blob", 2)]
    got = rows(L.title_index(spark.createDataFrame(nodes, "path string, type string, size long"), ["法"]), "title", "date", "year", "size")
    assert got == sorted([("甲法", "2001-02-03", None, 5), ("乙法", None, "2004", 0), ("己法", None, None, 2)], key=repr)
    files = spark.createDataFrame([("a/x.md",), ("a/y.md",), ("index.md",), ("a/x.md",)], "file string")
    assert rows(L.stale_files(files, files.limit(1))) == [("a/y.md",)]


def test_pairs_of_which_one_holds_the_other(spark, rows):
    import random

    from lawmill.operators.contain import containing

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("甲乙丙") for _ in range(n))
    o, i = [word(rng.randrange(9)) for _ in range(60)] + [None], [word(rng.randrange(6)) for _ in range(40)] + [None, "丁"]
    got = rows(containing(spark.createDataFrame([(x,) for x in o], "o string"), spark.createDataFrame([(x,) for x in i], "i string")))
    assert got == sorted({(a, b) for a in o for b in i if a and b and b in a}, key=repr)
    none = spark.createDataFrame([], "i string")
    assert containing(spark.createDataFrame([("a",)], "o string"), none).count() == 0
