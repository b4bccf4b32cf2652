import io
import zipfile

import pytest

from pyspark.sql import functions as F

from lawmill.functions.structure import document_heads
from lawmill.sources import files, index
from lawmill.streaming.ingest import event_windows, ingest_available

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paras):
    body = "".join(f"<w:p>{p}</w:p>" for p in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_archives_and_docx(spark, tmp_path):
    one = docx("<w:pPr><w:tabs><w:tab w:val='x'/></w:tabs></w:pPr><w:r><w:t>第一条 a&amp;b</w:t><w:br/><w:t xml:space='preserve'>第二条　​x</w:t></w:r>", "<w:r><w:t> </w:t></w:r>")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/甲_20200101.DOCX", one)
        z.writestr("bad.docx", b"no zip")
    (tmp_path / "b.zip").write_bytes(b"broken")
    found = files.read_archives(spark, str(tmp_path)).withColumn("p", files.docx_paragraphs("content")).collect()
    assert {r.name: (r.ext, r.p) for r in found if r.error is None} == {"甲_20200101.DOCX": (".docx", ["第一条 a&b", "第二条 x"]), "bad.docx": (".docx", None)}
    broken = [r for r in found if r.error]
    assert len(broken) == 1 and broken[0].archive.endswith("b.zip") and broken[0].name is None and "BadZipFile" in broken[0].error


def test_document_heads(spark):
    cases = {
        "marked": (["某法", "实施条例", "（2019年4月1日会议", "通过）", "中华人民共和国国务院令第 5 号", "目　录", "序言", "第一章 总则", "序言", "为了" * 20, "第一章 总则", "第一条 甲"], "某法实施条例"),
        "prose": (["关于修改的决定", "一、增加一款（法释〔2015〕11号）如下：", "二、删去"], "关于修改的决定"), "bare": (["规则", *[f"第{n}章 x{n}" for n in "一二三四五"], "第一章 x一", "第一条 甲"], "规则"),
        "four": (["规则", *[f"第{n}章 x{n}" for n in "一二三四"], "第一条 甲"], "规则"), "mark": (["规定", "(一) 保护是", "第一条 乙"], "规定"), "court": (["解释", "公 告", "最高人民法院", "法释〔2015〕11号", "2015年1月1日", "第一条 乙"], None),
        "none": ([], "甲"), "null": (None, None), "nulls": ([None, "第一条 乙", None], ""),
    }
    df = spark.createDataFrame([(k, p, t, "x") for k, (p, t) in cases.items()], "id string, p array<string>, `a.b` string, title string").withColumnRenamed("a.b", "name")
    got = {r.id: r["head"] for r in document_heads(df, "p", "name").collect()}
    h = got["marked"]
    assert h.history == "（2019年4月1日会议 通过）" and h.doc_number == "中华人民共和国国务院令第 5 号" and h.body[0] == "序言" and (h.article_count, h.chapter_count) == (1, 1)
    assert got["prose"].body == cases["prose"][0][1:] and got["prose"].doc_number == "" and got["bare"].body == ["第一章 x一", "第一条 甲"] and len(got["four"].body) == 5
    assert got["mark"].body[0] == "(一) 保护是" and got["mark"].history == "" and got["court"].body == ["第一条 乙"] and got["court"].doc_number == "法释〔2015〕11号"
    assert got["none"].body == [] and got["null"].title == "" and got["nulls"].title == "" and got["nulls"].article_count == 1
    assert document_heads(df.limit(0), "p", "name").count() == 0


def test_markdown_manifest_jsonl(spark, tmp_path, rows):
    df = spark.createDataFrame([("甲\"法", ["注"], ["第一章 总则", "第一条 乙"])], "title string, notes array<string>, body array<string>")
    text = df.select(files.render_markdown({"title": F.col("title"), "void": F.lit(None).cast("string")}, F.col("title"), F.col("notes"), F.col("body"))).collect()[0][0]
    assert text.split("\n") == ["---", 'title: "甲\\"法"', 'void: ""', "---", "", '# 甲"法', "> 注", "## 第一章 总则", "第一条 乙"]
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text(text)
    got = files.read_markdown(spark, str(tmp_path / "md")).select(files.front_matter(F.col("text")).alias("m")).collect()[0].m
    assert got["void"] == ""
    (tmp_path / "m.json").write_text('{"retrieved": "2026-01-01", "laws": [{"title": "甲", "layer": "current", "extra": 1}, {"title": "乙"}]}')
    assert rows(files.read_manifest(spark, str(tmp_path / "m.json")), "retrieved", "title", "layer") == sorted([("2026-01-01", "甲", "current"), ("2026-01-01", "乙", None)], key=repr)
    records = spark.createDataFrame([("b1", None)], "bbbs string, title string")
    files.write_jsonl(records, str(tmp_path / "j"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "j"), files.LOCAL_RECORD), "bbbs", "title") == [("b1", None)]
    vec = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "key string, vec array<double>")
    files.write_vectors(vec, str(tmp_path / "v"))
    assert {r.key: [round(x, 4) for x in r.vec] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"a": [0.6, 0.8], "z": [0.0, 0.0]}
    assert rows(files.pending(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, h string"), spark.createDataFrame([("a", "1"), ("b", "1")], "k string, h string"), ["k", "h"])) == [("b", "2")]


def test_ingest_sees_each_file_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.md").write_text("第一条 甲")
    run = lambda: ingest_available(spark, str(land), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    (land / "b.md").write_text("## 第一章\n第二条 乙")
    run()
    run()
    assert sorted((r.article, r.chapter) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("第一条", ""), ("第二条", "第一章")]


def test_event_windows(spark):
    df = spark.createDataFrame([("2026-01-01 00:01:00", "a", 1.0), ("2026-01-01 00:09:00", "a", 2.0), ("2026-01-01 00:11:00", "a", None)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.n, r.value) for r in event_windows(df).select("n", F.coalesce("value", F.lit(0.0)).alias("value")).collect()) == [(1, 0.0), (2, 3.0)]


def test_expansions_and_notes(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"_c": ["no"], "缺": ["无", "短缺"], "text": "no list", "空": [], "n": [null, "甲"]}')
    got = files.expansion_map(files.read_expansions(spark, str(tmp_path / "e.json")))
    assert got == {"缺": ["无", "短缺"] if got["缺"][0] == "无" else ["短缺", "无"], "n": ["甲"]}
    texts = [(1, "说明\n" + files.INFO_MARK + "\n# 题\n正文 "), (2, " # 题"), (3, "正文\n# 题"), (4, None)]
    notes, body = files.split_info_block(F.col("t"))
    rows = spark.createDataFrame(texts, "i int, t string").select("i", notes.alias("n"), files.without_heading(body).alias("b")).orderBy("i").collect()
    assert [(r.n, r.b) for r in rows] == [("说明", "正文"), ("", ""), ("", "正文\n# 题"), ("", None)]


def test_an_index_with_its_meta_data(spark, tmp_path):
    import numpy as np

    vec = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "key string, vec array<double>")
    index.write_index(vec, str(tmp_path / "i"), "m", 2, corpus_hash="sha256:x")
    got, meta = index.read_index(spark, str(tmp_path / "i"), 2)
    assert meta == {"model": "m", "dim": 2, "count": 2, "partial": False, "corpus_hash": "sha256:x", "metadata_hash": ""} and got.count() == 2
    with pytest.raises(ValueError):
        index.read_index(spark, str(tmp_path / "i"), 3)
    np.savez_compressed(tmp_path / "v.npz", keys=np.array(["甲#1", "乙#2"], dtype="U"), vectors=np.array([[3, 4], [0, 0]], dtype=np.float16))
    assert {r.key: [round(x, 4) for x in r.vec] for r in index.read_arrays(spark, str(tmp_path / "v.npz")).collect()} == {"甲#1": [0.6, 0.8], "乙#2": [0.0, 0.0]}
    assert index.meta_of('{"model": "m"}')["dim"] is None


def test_a_corpus_from_archives(spark, tmp_path):
    from lawmill.operators import build

    lines = ["甲法", "（2001年1月1日通过）", "第一章 总则", "第一条 乙", "第二条 本法自2001年3月1日起施行。"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/甲法_20010101.docx", docx(*[f"<w:r><w:t>{x}</w:t></w:r>" for x in lines]))
        z.writestr("x/丙法（失效）_19990101.docx", docx("<w:r><w:t>丙法</w:t></w:r>"))
        z.writestr("x/最高人民法院解释_20050101.docx", b"broken")
        z.writestr("x/note.txt", b"no")
    official = spark.createDataFrame([("甲法", "2001-01-01", 3, "现行有效", "", "法律", "某会"), ("丙法", "1999-01-01", 3, "现行有效", "1999-02-02", None, None)],
                                     "title string, date string, status_code int, status string, effective string, category string, issuer string")
    made = {r.title: r for r in build.corpus(build.archived_files(spark, str(tmp_path)), official).collect()}
    a, c, e = made["甲法"], made["丙法"], made["最高人民法院解释"]
    assert (a.category, a.layer, a.status, a.effective, a.effective_source, a.issuer, a.article_count, a.text_status) == ("法律", "current", "现行有效", "2001-03-01", "text", "某会", 2, "full")
    assert a.file == "corpus/法律/甲法(2001-01-01).md" and "> 沿革：（2001年1月1日通过）" in a.text and "## 第一章 总则" in a.text and "施行：2001-03-01（正文推定）" in a.text
    assert (c.category, c.layer, c.status, c.effective_source) == (build.NO_CATEGORY, "historical", build.VOID_STATUS, "official") and build.NOT_CURRENT in c.text
    assert (e.category, e.status, e.text_status) == ("高法司法解释", build.NO_STATUS, "metadata-only") and build.NO_TEXT in e.text
    counts = build.envelope(spark.createDataFrame(list(made.values()))).first()
    assert counts["count"] == 3 and counts.by_layer == {"current": 2, "historical": 1}
    assert build.corpus(build.archived_files(spark, str(tmp_path)).limit(0), official).count() == 0
