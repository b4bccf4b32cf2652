import math
import random

import numpy as np
from pyspark.sql import functions as F

from lawmill.operators import bm25 as B
from lawmill.operators import evaluation as E
from lawmill.operators import fusion, segments
from lawmill.operators.terms import build_terms

EXP = {"_c": ["no"], "被辞退": ["经济补偿", "解除合同"], "缺": ["无"]}


def test_terms(spark, rows):
    q = spark.createDataFrame([(1, "公司被辞退，经济补偿Abé"), (2, None), (3, ""), (None, "甲乙"), (4, "甲" * 17)], "qid int, text string")
    got = {(r.qid, r.term): (r.weight, r.kind, r.min_df) for r in build_terms(q, "qid", "text", EXP).collect()}
    assert got[1, "公司被辞退"] == (1.0, "phrase", 1) and got[1, "经济补偿Ab"] == (1.0, "phrase", 1)
    assert got[1, "经济补偿"] == (0.85, "gram", 2) and got[1, "解除合同"] == (0.8, "expansion", 1) and got[1, "Ab"] == (0.45, "gram", 8)
    assert (1, "被辞") not in got and (1, "无") not in got and not any(q in (2, 3, None) for q, _ in got)
    assert (4, "甲" * 17) not in got and got[4, "甲甲"] == (0.45, "gram", 8)
    assert rows(build_terms(q.limit(0), "qid", "text")) == []


def plain_bm25(docs, terms):
    n, avg = len(docs), sum(len(b) for _, _, b in docs) / len(docs)
    scores = {}
    for q, t, w, kind, floor in terms:
        tf = {k: b.count(t) for k, _, b in docs if t in b}
        lo, hi = min(floor if kind == "gram" else 1, max(1, int(0.02 * n))), max(0.05 * (0.5 if kind == "phrase" else 1) * n, 50)
        if not tf or not lo <= len(tf) <= hi:
            continue
        idf = math.log(1 + (n - len(tf) + 0.5) / (len(tf) + 0.5))
        for k, title, b in docs:
            if k in tf:
                scores[q, k] = scores.get((q, k), 0) + w * idf * (tf[k] * 2.2 / (tf[k] + 1.2 * (0.4 + 0.6 * len(b) / avg)) + (1.5 if t in title else 0))
    return scores


def test_bm25_against_plain_python(spark):
    rng = random.Random(1)
    docs = [(f"k{i}", "".join(rng.choices("甲乙丙", k=3)), "".join(rng.choices("甲乙丙丁戊", k=rng.randrange(0, 40)))) for i in range(120)]
    terms = [(q, t, 0.5, kind, floor) for q in (1, 2) for t, kind, floor in (("甲甲", "gram", 2), ("乙丙", "phrase", 1), ("丙丁", "gram", 2), ("甲乙丙", "expansion", 1), ("庚", "gram", 1))]
    got = B.bm25(spark.createDataFrame(docs, "key string, title string, body string").withColumn("article", F.lit("a")), spark.createDataFrame(terms, "qid int, term string, weight double, kind string, min_df int"))
    got = {(r.qid, r.key): r.score for r in got.collect()}
    want = plain_bm25(docs, terms)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_bm25_nulls_and_empty(spark, rows):
    docs = spark.createDataFrame([("a", None, "甲乙", None), ("b", "x", None, "y")], "key string, title string, body string, article string")
    terms = spark.createDataFrame([(1, "甲乙", 1.0, "phrase", 1)], "qid int, term string, weight double, kind string, min_df int")
    assert [r.key for r in B.bm25(docs, terms).collect()] == ["a"]
    assert rows(B.bm25(docs.limit(0), terms)) == [] and rows(B.bm25(docs, terms.limit(0))) == []


TEXT = """---
title: "x"
---
# 某法
> 注
## 第一编 总则
## 第一章 开始
第一条　甲
乙

## 第二 节 其他
第二百七十一 条 丙
（一）丁
## 第二编 分则
第三条之二 戊
## 附则
第四条己
"""


def test_clauses(spark):
    df = spark.createDataFrame([(1, TEXT, "t"), (2, None, "t"), (3, "", "t"), (4, "没有条文\n## 第一章", "t")], "id int, text string, body string")
    got = [tuple(r) for r in segments.clauses(df.select("id", "text"), "text").orderBy("id", "line").collect()]
    assert got == [
        (1, "第一条", "第一编 总则 第一章 开始", "第一条　甲 乙", 8), (1, "第二百七十一", "第一编 总则 第二 节 其他", "第二百七十一 条 丙 （一）丁", 12),
        (1, "第三条之二", "第二编 分则", "第三条之二 戊", 15), (1, "第四条己", "附则", "第四条己", 17),
    ]


def test_paragraphs_and_hits(spark, rows):
    df = spark.createDataFrame([("第一条 甲\n（一）乙\n# 略\n丙",), ("一段",), (None,)], "b string")
    assert [r[0] for r in df.select(segments.paragraphs(F.col("b"), F.lit("法"))).collect()] == [["法 第1款 第一条 甲 （一）乙", "法 第2款 丙"], ["法 一段"], ["法"]]
    docs = spark.createDataFrame([(1, "## 章\n甲\n甲乙\n> 丙\n第一条 乙\n甲"), (2, "> 甲乙"), (3, None)], "id int, text string")
    assert rows(segments.hits_per_text(docs, "id", "text", ["甲", "乙"], most=2)) == [(1, 2, "甲", "章"), (1, 3, "甲乙", "章")]
    assert rows(segments.hits_per_text(docs, "id", "text", ["丙", "甲"])) == [] and rows(segments.hits_per_text(docs, "id", "text", [])) == []


def test_vectors_fusion_and_rerank(spark, rows):
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((60, 8)), rng.standard_normal((3, 8))
    index = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 8)], "key string, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(9, None)], "qid int, vec array<double>")
    got = {(r.qid, r["rank"]): r.key for r in fusion.vector_search(queries, index, 8, 5).collect()}
    for i in range(3):
        s = np.round((x @ q[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(q[i]), 6)
        assert [got[i, r] for r in range(1, 6)] == [f"k{j:02d}" for j in np.lexsort((np.arange(60), -s))[:5]]
    lists = spark.createDataFrame([(1, "a", 1, 9.0), (1, "b", 2, 8.0)], "qid int, key string, rank int, score double")
    other = spark.createDataFrame([(1, "b", 1, 0.9), (1, "c", 3, 0.8)], "qid int, key string, rank int, score double")
    h = {r.key: (r.bm25, r.cosine, r.rrf) for r in fusion.hybrid(lists, other).collect()}
    assert h["a"] == (9.0, None, round(1 / 61, 9)) and h["b"] == (8.0, 0.9, round(1 / 62 + 1 / 61, 9)) and h["c"] == (None, 0.8, round(1 / 63, 9))
    assert {r.key: r.rrf for r in fusion.multi_route([lists, other], 2).collect()} == {"a": round(1 / 61, 9), "b": round(1 / 62 + 1 / 61, 9)}
    order = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("abcd")], "qid int, key string, rank int")
    scores = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "c", 0.9)], "qid int, key string, score double")
    ranks = lambda mode: [k for k, _ in sorted(((r.key, r["rank"]) for r in fusion.rerank_head(order, scores, 3, mode).collect()), key=lambda p: p[1])]
    assert ranks("replace") == ["c", "b", "a", "d"] and ranks("fuse") == ["a", "c", "b", "d"]


def test_evaluation(spark, rows):
    ref = "array<struct<law:string,article:string>>"
    q = spark.createDataFrame([(1, "x", [("L", "1"), ("L", "2")], None), (2, "x", [("L", "9")], [("L", "3")]), (3, "y", [], None), (4, "y", None, [("L", "1")])], f"qid int, kind string, must_include {ref}, acceptable {ref}")
    res = spark.createDataFrame([(1, 2, "L", "1"), (1, 9, "L", "2"), (2, 4, "L", "3"), (2, 60, "L", "9"), (3, 1, "L", "1")], "qid int, rank int, law string, article string")
    pos = E.answer_positions(res, q)
    assert {r.qid: (r.positions, r.all_within, r.first) for r in pos.collect()} == {1: ([2, 9], 9, 2), 2: ([], None, 4), 3: ([], None, None), 4: ([], None, None)}
    at = {r.k: (r.recall, r.hit, r.all_hit) for r in E.rates_at_k(pos).collect()}
    assert at[3] == (0.333333, 0.5, 0.0) and at[10] == (0.666667, 1.0, 0.5)
    assert set(rows(E.mean_reciprocal_rank(pos))) == {(8, 0.375), (20, 0.375)} and rows(E.hit_histogram(pos)) == [(2, 1), (4, 1)]
    corpus = spark.createDataFrame([("L", "1")], "law string, article string")
    assert rows(E.unknown_answers(q, corpus)) == [(1, "L", "2"), (2, "L", "9")]


def test_ranks_without_sorting_the_whole(spark):
    rng = random.Random(4)
    scores = [(q, f"k{i:03d}", rng.choice(["t", None, "u"]), rng.choice(["a", "b"]), float(rng.randrange(30))) for q in range(3) for i in range(200)]
    df = spark.createDataFrame(scores, "qid int, key string, title string, article string, score double")
    wanted = [(q, f"k{rng.randrange(260):03d}") for q in range(4) for _ in range(40)]
    whole = {(r.qid, r.key): r["rank"] for r in B.ranked(df, 10**6).collect()}
    got = {(r.qid, r.key): r["rank"] for r in B.ranks_of(df, spark.createDataFrame(wanted, "qid int, key string").distinct()).collect()}
    assert got == {k: whole[k] for k in wanted if k in whole}


def test_routes_in_one_pass_equal_routes_alone(spark):
    docs = spark.createDataFrame([("a", "甲法", "一", "甲乙丙甲乙"), ("b", "乙法", "二", "乙丙"), ("c", None, None, "甲")], "key string, title string, article string, body string")
    terms = [(1, "r", "甲乙", 1.0, "phrase", 1), (1, "s", "乙丙", 0.5, "phrase", 1), (2, "s", "甲", 0.5, "phrase", 1), (1, "s", "甲乙", 0.3, "phrase", 1)]
    df = spark.createDataFrame(terms, "qid int, route string, term string, weight double, kind string, min_df int")
    both = {(r.qid, r.route, r.key): r.score for r in B.bm25(docs, df, ("qid", "route")).collect()}
    alone = {(r.qid, x, r.key): r.score for x in "rs" for r in B.bm25(docs, df.filter(F.col("route") == x).drop("route")).collect()}
    assert both == alone and len(both) == 5


def test_many_terms_in_several_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(f"k{i}", "甲", "一", chr(0x4E00 + i) + chr(0x4E01 + i)) for i in range(60)], "key string, title string, article string, body string")
    df = spark.createDataFrame([(1, chr(0x4E00 + i), 1.0, "phrase", 1) for i in range(60)], "qid int, term string, weight double, kind string, min_df int")
    whole = sorted((r.key, r.score) for r in B.bm25(docs, df).collect())
    monkeypatch.setattr(B, "TERMS_AT_ONCE", 20)
    assert sorted((r.key, r.score) for r in B.bm25(docs, df).collect()) == whole and len(whole) == 60


def test_the_best_of_a_partition_over_its_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i:04d}", [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(500)]
    index = spark.createDataFrame(rows, "key string, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = [(r.key, r.score) for r in fusion.vector_search(spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (2, None)], "qid int, vec array<double>"), index, 3, 9).orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    q = np.array([1.0, 2.0, 0.5])
    want = sorted((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 6), k) for k, v in rows if any(v))[:9]
    assert [k for k, _ in got] == [k for _, k in want]


def test_segments_are_scored_one_by_one(spark):
    body = "\n".join(["甲甲甲甲", "（一）乙", "丙丙丙丁", *["戊"] * 9])
    docs = spark.createDataFrame([("a", "题", "条", body), ("b", "题", "条", "甲丙戊"), ("c", None, None, None)], "key string, title string, article string, body string")
    every = docs.select(F.size(segments.paragraphs(F.col("body"), F.lit("h"))).alias("n"), F.size(segments.paragraphs(F.col("body"), F.lit("h"), 8)).alias("m")).collect()
    assert [tuple(r) for r in every] == [(11, 8), (1, 1), (1, 1)]
    pool = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "b", 1)], "qid int, key string, rank int")
    q = spark.createDataFrame([(1, "丙丙丁"), (2, "")], "qid int, text string")
    hits = fusion.segment_scores(pool, q, docs, segments.paragraphs(F.col("body"), F.lit("")), lambda c: fusion.char_histogram(c, 64))
    assert hits.filter("key = 'a'").count() == 11
    best = {(r.qid, r.key): r["rank"] for r in fusion.best_segment(hits.filter("score is not null"), "key", 5).collect()}
    assert best[1, "a"] == 1
    fused = fusion.rerank_head(pool, spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.1)], "qid int, key string, score double"), 2, "replace")
    assert [(r.qid, r.key) for r in fused.orderBy("qid", "rank").collect()] == [(1, "b"), (1, "a"), (1, "c"), (2, "b")]


def test_article_blocks(spark):
    df = spark.createDataFrame([(1, TEXT, "t"), (2, None, "t"), (3, "第一条 甲\n乙\n第一条之二 丙", "t"), (4, "第二条 第一条", "t")], "id int, t string, line string")
    got = {r.id: (r.line, r.block) for r in segments.article_blocks(df, "id", "t", F.lit("第一条"), ["甲", "乙"]).collect()}
    assert got == {1: (8, "第一条　甲\n乙\n\n## 第二 节 其他"), 3: (1, "第一条 甲\n乙")}
    assert segments.article_blocks(df, "id", "t", F.lit("第一条"), ["无"]).count() == 0


def test_chapters_of_many_marks(spark):
    text = "\n".join(f"## 第{'一二三四'[i % 4]}{'编章节章'[i % 4]} h{i}\n第一条 a{i}" for i in range(40))
    got = {r.body.split(" ")[1]: r.chapter for r in segments.clauses(spark.createDataFrame([(1, text)], "i int, t string"), "t").collect()}
    assert got["a0"] == "第一编 h0" and got["a6"] == "第一编 h4 第三节 h6" and got["a39"] == "第一编 h36 第四章 h39"
