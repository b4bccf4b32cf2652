import unicodedata

import pytest

from lawmill.llm import lookalike as L

COLUMNS = "row_id long, file string, body string, field string, form string, id long"


def forms(spark, values):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, s string, c0 string")
    return [r[0] for r in L.consistent_form(df, {"s": "f"}).orderBy("i").select("f").collect()]


def test_what_looks_the_same_becomes_one(spark):
    groups = [
        ["第一条", "第⼀条", "​第一﻿条　", " 第一条", "第­一条"], ["PM2.5，限值", "РМ2.5,限值", "ＰＭ２．５，限值", "ΡΜ2.5，限值"], ["é", "é", "е́"], ["門⻔", "門门"],
        ["a b", "a　b", "a b"], ["｡ｱ", "。ア"], ["", " ​　"],
    ]
    for g in groups:
        assert len(set(forms(spark, g))) == 1, g


def test_what_looks_different_stays_apart(spark):
    for a, b in [("①", "1"), ("m²", "m2"), ("（一）", "〔一〕"), ("第 一条", "第一条"), ("三", "3"), ("a  b", "a b"), ("㎡", "m2"), ("A", "a"), ("日", "曰"), ("未", "末"), ("0", "O"), ("℃", "°C")]:
        assert len(set(forms(spark, [a, b]))) == 2, (a, b)


def test_by_rule_every_width_and_radical_form(spark):
    wide = [chr(c) for c in [*range(0xFF01, 0xFF5F), *range(0x2F00, 0x2FD6), *range(0xF900, 0xFA0E)]]
    got = forms(spark, wide)
    assert all(f == unicodedata.normalize("NFKC", w) for w, f in zip(wide, got))


def test_nulls_long_texts_and_clashing_names(spark):
    assert forms(spark, [None, "，" * 100_000 + "Ａ"]) == [None, "," * 100_000 + "A"]
    with pytest.raises(ValueError):
        L.consistent_form(spark.createDataFrame([("a", "b")], "s string, f string"), {"s": "f"})
    assert L.consistent_form(spark.createDataFrame([], "s string"), {"s": "f"}).count() == 0


def found(spark, data):
    df = spark.createDataFrame([(*r, "x", "y", 7) for r in data], COLUMNS)
    keys = L.form_keys([("body", df, "row_id", "body", None), ("scoped", df, "row_id", "body", "file")], "t")
    return sorted(tuple(r) for r in L.lookalike_pairs(keys).collect()), sorted(tuple(r) for r in L.lookalike_classes(keys).collect())


def test_pairs_and_classes(spark):
    data = [(1, "f", "Ａ"), (2, "f", "A"), (3, "g", "A"), (4, "g", None), (5, None, "A "), (6, None, "A"), (7, "h", "B"), (8, "h", "B")]
    pairs, classes = found(spark, data)
    assert [p[1:] for p in pairs if p[0] == "body"] == [(1, 2), (1, 3), (1, 5), (1, 6), (2, 5), (3, 5), (5, 6)]
    assert [p[1:] for p in pairs if p[0] == "scoped"] == [(1, 2), (5, 6)]
    assert [c[1:] for c in classes if c[0] == "body"] == [(i, 1, 5) for i in (1, 2, 3, 5, 6)]
    assert found(spark, []) == ([], [])
