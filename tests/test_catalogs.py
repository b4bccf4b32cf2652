import hashlib
import json
import unicodedata

from pyspark.sql import functions as F

from lawmill.functions import numerals, titles
from lawmill.operators import audit, catalog


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_numerals(spark):
    assert one(spark, [1, 10, 15, 20, 101, 110, 271, 1000, 1008, 1260, 9999, 0, -3, None, 10000], numerals.to_han, "int") == [
        "一", "十", "十五", "二十", "一百零一", "一百一十", "二百七十一", "一千", "一千零八", "一千二百六十", "九千九百九十九", "", "", None, None,
    ]
    assert one(spark, ["88", "八十八", "八十八条", "第八条之一", None], numerals.article_label) == ["第八十八条", "第八十八条", "第八十八条", "第八条之一", "第条"]
    assert one(spark, ["1993", "一九九三", "二十", "十", "十二", "三十一", "百", "", None], numerals.han_to_int) == [1993, 1993, 20, 10, 12, 31, None, None, None]
    texts = ["自2019年7月1日起施行。后于一九九三年十二月二十日起施行", "自公布之日起施行", "无", None]
    assert one(spark, texts, lambda c: numerals.effective_in_text(F.coalesce(c, F.lit("")), F.lit("2001-01-01"))) == ["1993-12-20", "2001-01-01", "", ""]
    assert one(spark, texts[:3], lambda c: numerals.effective_in_text(c, F.lit(None).cast("string"))) == ["1993-12-20", "", ""]
    assert one(spark, ["2026-01-01", "x", None], lambda c: numerals.snapshot_age(c, F.to_date(F.lit("2026-06-30")))) == [180, None, None]


def test_titles(spark):
    names = ["民法典_20200528.docx", "a/关于+++修改的决定（失效）_20010101.doc", "无日期.docx", None]
    got = [one(spark, names, _part(k)) for k in ("title", "date", "voided")]
    assert got == [["民法典", "关于、修改的决定", "无日期", None], ["20200528", "20010101", None, None], [False, True, False, None]]
    assert one(spark, ["网络数据安全管理条例", "条例", "城市管理办法实施细则"], titles.core_phrase) == ["网络数据安全管理", "条例", "城市管理办法实施细则"]
    assert one(spark, ["某市人民代表大会常务委员会", "某省人民政府办公厅", None], titles.issuer_region) == ["某市", "某省", ""]
    assert one(spark, [" <b>中华人民共和国民法典（草案）</b>"], titles.norm_title) == ["民法典"]
    stems = one(spark, ["短", "长" * 120, None], lambda c: titles.safe_stem(F.coalesce(c, F.lit("空")), F.lit("20200101"), F.lit("类")))
    assert stems[0] == "短(20200101)" and len(("corpus/类/" + stems[1] + ".md").encode()) <= 255 and stems[1][-7] == "-" and stems[2] == "空(20200101)"
    url = 'x?response-content-disposition=attachment%3Bfilename%3D%22%25E6%25B3%2595_20200101.docx%22'
    assert one(spark, [url, "nothing"], lambda c: titles.download_name(c, F.lit("http://i/?fileName=%E5%86%85.docx"))) == ["法_20200101.docx", "内.docx"]
    assert one(spark, ['a"b\\', None], titles.yaml_value) == ['"a\\"b\\\\"', '""']


def _part(k):
    return lambda c: titles.split_name(c)[k]


def test_match_official(spark):
    files = spark.createDataFrame(
        [("a", "甲法", "2020-01-01", False), ("b", "甲法", "2021-01-01", False), ("c", "甲法", "2019-01-01", False), ("d", "乙、法", "2020-01-01", True), ("e", "丙", None, False),
         ("f", None, "2020-01-01", False), ("g", "关于修改甲法的决定", None, False), ("h", "丁", "2020-01-01", False)],
        "file string, title string, date string, voided boolean",
    )
    official = spark.createDataFrame(
        [("甲法", "2020-01-01", 4, "尚未生效", "2020-02-01"), ("甲法", "2020-01-01", 4, "尚未生效", "2020-02-01"), ("甲法", "2018-01-01", 1, "已废止", ""), ("乙 法", "2020-01-01", 3, "现行有效", ""), ("丁", "2020-01-01", None, None, None), (None, None, 3, "x", "")],
        "title string, date string, status_code int, status string, effective string",
    )
    got = {r.file: (r.how, r.status_code, r.layer, r.promulgated, r.effective) for r in catalog.match_official(files, official).collect()}
    assert got == {
        "a": ("exact", 4, "current", "2020-01-01", "2020-02-01"), "b": ("title", 3, "current", "2021-01-01", ""), "c": ("title", 2, "historical", "2019-01-01", ""),
        "d": ("key", 3, "historical", "2020-01-01", ""), "e": ("none", None, "current", None, None), "f": ("none", None, "current", None, None), "g": ("none", None, "decision", None, None),
        "h": ("exact", None, "decision", "2020-01-01", None),
    }
    assert catalog.match_official(files.limit(0), official).count() == 0 and catalog.match_official(files, official.limit(0)).filter("how <> 'none'").count() == 0


def test_sources_upsert_names_search(spark, rows):
    wanted = spark.createDataFrame([(1, "t", "2020-05-01"), (2, "t", "2018-01-01"), (3, "u", "2020-01-01"), (4, "v", "x")], "key int, title string, promulgated string")
    sources = spark.createDataFrame([("t", "2020-05-01", "p1"), ("t", "2020-07-01", "p2"), ("t", "2018-09-09", "p3"), ("u", None, "p5"), ("u", None, "p4"), ("v", "2001-01-01", "p6"), ("v", "2002-01-01", "p7")], "title string, date string, path string")
    assert {r.key: (r.path, r.tier) for r in catalog.pick_source(wanted, sources).collect()} == {1: ("p1", 0), 2: ("p3", 1), 3: ("p4", 3), 4: ("p7", 2)}
    a, b = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert rows(catalog.upsert(a, b, ["k"], F.col("v"))) == [(1, "old"), (2, "new"), (3, "new")]
    named = catalog.numbered_names(spark.createDataFrame([("n", 1), ("n", 2), ("m", 1), ("n", 3)], "name string, o int"), "name", "o")
    assert sorted(r.unique_name for r in named.collect()) == ["m", "n", "n-2", "n-3"]
    q = spark.createDataFrame([(1, "数据安全条例"), (2, "办法"), (3, None), (4, "不存在的标题")], "qid int, query string")
    entries = spark.createDataFrame([("数据安全条例", "2020", "行政法规"), ("数据安全", "2021", "地方法规"), ("数据安全法", "2022", "法律"), ("某省数据安全办法", "2019", None), (None, "1", None), ("数据安全法", "2022", "法律")], "title string, promulgated string, category string")
    got = {(r.qid, r["rank"]): (r.title, r.score) for r in catalog.title_search(q, entries).collect()}
    assert got == {(1, 1): ("数据安全条例", 4.0), (1, 2): ("数据安全", 3.0), (1, 3): ("数据安全法", 2.5), (1, 4): ("某省数据安全办法", 2.0), (2, 1): ("某省数据安全办法", 2.0)}
    use = catalog.expansion_use({"_x": ["a"], "k": ["甲", "无"]}, spark.createDataFrame([("f", "甲乙"), ("f", "甲"), ("g", None)], "file string, body string"), "file", "body")
    assert rows(use) == [("k", "无", 0), ("k", "甲", 1)] or rows(use) == [("k", "甲", 1), ("k", "无", 0)]


CLAUSES = "title string, article string, body string, status string, layer string, file string"
TWO = [("民法典", "第一条", "ＡＢ　x\r\n ", "现行有效", "current", "f.md"), ("民法典", "第二条", None, None, "current", "f.md")]


def canonical(r):
    n = lambda v: unicodedata.normalize("NFKC", v or "").replace("\r\n", "\n").strip()
    law, article, body, status, layer, file = map(n, r)
    h = lambda v: "sha256:" + hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return f"{law}/{article}", h({"law": law, "article": article, "body": body, "status": status, "layer": layer, "file": file}), h


def test_hashes_and_fingerprints(spark, rows):
    df = spark.createDataFrame(TWO, CLAUSES)
    hashes = audit.clause_hashes(df)
    want = sorted(canonical(r)[:2] for r in TWO)
    assert rows(hashes, "key", "hash") == want
    exact = audit.exact_fingerprint(hashes, "key", "hash").collect()[0][0]
    assert exact == canonical(TWO[0])[2]([{"key": k, "hash": h} for k, h in want])
    mark = lambda d: audit.fingerprint(d, *[F.col(c) for c in d.columns]).collect()[0]
    assert mark(df) == mark(spark.createDataFrame(TWO[::-1], CLAUSES)) and mark(df)[1] == 2
    assert mark(df)[0] != mark(spark.createDataFrame([TWO[0], (*TWO[1][:2], "y", *TWO[1][3:])], CLAUSES))[0] and mark(df.union(df))[0] != mark(df)[0]
    assert mark(df.limit(0))[1] == 0


def test_index_state(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("c", "1")], "key string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "key string, hash string")
    diff = audit.index_diff(old, new)
    assert rows(diff) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    cover = audit.coverage(new, old)
    assert rows(cover) == [(3, 2, 0.666667)] and rows(audit.coverage(new.limit(0), old)) == [(0, 0, 0.0)]
    assert rows(audit.gate(diff, cover)) == [("stale", 3, False, "conditional")]
    assert rows(audit.gate(diff.limit(0), cover)) == [("uncovered", 0, False, "allowed")] and rows(audit.gate(diff.limit(0), audit.coverage(old, old))) == [("valid", 0, True, "allowed")]
    assert rows(audit.gate(diff, cover, enabled=False))[0][0] == "disabled" and rows(audit.gate(diff, cover, present=False))[0][0] == "missing"


def test_a_void_mark_is_no_part_of_an_official_title(spark, tmp_path):
    from lawmill.plans.catalogs import catalog_match

    spark.createDataFrame([("2026-01", "甲<b>法</b>（失效）", "法律", "x", "已失效", -1, "2001-01-01", "2001-02-01", None), ("2026-01", "乙法(已失效)", "法律", "x", "已失效", -1, "2002-01-01", None, None)],
                          "snapshot string, title string, category string, issuer string, status string, status_code int, promulgated string, effective string, received_at timestamp").write.parquet(f"{tmp_path}/check_updates.parquet")
    spark.createDataFrame([(1, "c/甲法（失效）_20010101.docx", None, None), (2, "c/乙法_20020101.docx", None, None), (3, "c/丙法_20020101.docx", None, None)], "row_id long, file string, retrieved string, loaded_at timestamp").write.parquet(f"{tmp_path}/build_from_downloads.parquet")
    got = {r.file[2:4]: (r.how, r.layer) for r in catalog_match(spark, str(tmp_path)).collect()}
    assert got == {"甲法": ("exact", "historical"), "乙法": ("exact", "historical"), "丙法": ("none", "current")}


def test_exact_fingerprints_and_states(spark):
    import hashlib
    import json

    from lawmill.operators import audit

    rows = [("a/一", "h2"), ("a/一", "h1"), ("\"b\"/二", "h3")]
    want = "sha256:" + hashlib.sha256(json.dumps([{"hash": h, "key": k} for k, h in sorted(rows)], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    for order in (rows, rows[::-1]):
        got = audit.exact_fingerprint(spark.createDataFrame(order, "key string, hash string").repartition(3), "key", "hash").collect()
        assert [tuple(r) for r in got] == [(want, 3)]
    changed = audit.exact_fingerprint(spark.createDataFrame([("a/一", "h2"), ("a/一", "h1"), ("\"b\"/二", "h4")], "key string, hash string"), "key", "hash").first()[0]
    assert changed != want and audit.exact_fingerprint(spark.createDataFrame([], "key string, hash string"), "key", "hash").first()[0] == "sha256:" + hashlib.sha256(b"[]").hexdigest()
    old, new = spark.createDataFrame([("a", "1"), ("b", None)], "key string, hash string"), spark.createDataFrame([("a", "1"), ("b", "2")], "key string, hash string")
    assert [tuple(r) for r in audit.index_diff(old.filter("hash is not null"), new).collect()] == [("b", "added")]  # a missing hash is stale
    state = spark.createDataFrame([(True, 0, 1.0), (True, 2, 1.0), (True, 0, 0.5), (False, 0, 1.0)], "v boolean, n long, s double")
    status = [r[0] for r in state.select(audit.index_status(True, True, F.col("v"), F.col("n"), F.col("s"))).collect()]
    assert status == ["valid", "stale", "uncovered", "unverified"]
    report = audit.audit_report(spark.createDataFrame([(1, 0)], "qid int, candidates long"), spark.createDataFrame([("unverified", 0)], "status string, changed_clauses long"), ("current", "historical")).first().audit
    report = json.loads(report)
    assert report["stage"] == "no_results" and report["retrieval"]["historical_included"] and report["answer_gate"]["status"] == "allowed" and report["index"]["hash_match"]


def test_unknown_answers_are_listed(spark):
    from lawmill.operators import evaluation

    q = spark.createDataFrame([(1, [("甲法", "第一条"), ("甲法", "第九条")]), (2, None)], "qid int, must_include array<struct<law:string,article:string>>")
    got = evaluation.unknown_answers(q, spark.createDataFrame([("甲法", "第一条"), (None, None)], "law string, article string")).collect()
    assert [tuple(r) for r in got] == [(1, "甲法", "第九条")]
