import numpy as np
import pandas as pd

from lawmill.llm import linkage as K
from lawmill.session import staged

LAWS = "file string, title string, promulgated string, effective string, issuer string, loaded_at timestamp, bbbs string, place string"
LOCAL = "bbbs string, title string, region string, issuer string, promulgated string, effective string, fetched_at timestamp, file string, core string"


def laws(spark, rows):
    return spark.createDataFrame([(f"corpus/x/{t}_{d.replace('-', '')}.md", t, d, e, None, None, "q", "r") for t, d, e in rows], LAWS)


def local(spark, rows):
    return spark.createDataFrame([(b, t, r, None, d, e, None, "q", "r") for b, t, r, d, e in rows], LOCAL)


BASE = [("甲山县食品安全管理办法", "2010-05-01", "2010-07-01"), ("甲山县食品安全管理办法", "2018-05-01", ""), ("甲山县食品安全管理若干规定", "2010-05-01", None), ("甲山县供水管理办法", "2010-05-01", None),
        ("乙水市食品安全管理办法", "2010-05-01", None), ("乙水市旅游促进条例", "2015-01-01", "2015-03-01")]


def found(spark, rows, base=BASE):
    got = K.linked(laws(spark, base), local(spark, rows)).filter("confidence > 0.5").collect()
    return sorted((r.bbbs, r.file.split("/")[-1]) for r in got)


def test_noise_is_bridged_and_others_stay_apart(spark):
    rows = [
        ("same", "甲山县食品安全管理办法", "甲山县", "2010-05-01", None), ("late", "<em>某省甲山县·食品安全管理办法</em>", None, "2010年5月20日", None), ("swap", "食品安全管理法办（2010年公布）", "甲山县", "20100501", None),
        ("trad", "關於印發甲山縣食品安全管理辦法的公告".replace("關於印發", "关于印发"), "甲山县", "2010.5.1", None), ("lost", "甲山县食品安全管办法", "甲山县", "2010-05-01", None), ("years", "甲山县食品安全管理办法", "甲山县", "2014-05-01", None),
        ("moved", "甲山县食品安全办管理法", "甲山县", "2010-05-01", None), ("other", "甲山县供热管理办法", "甲山县", "2010-05-01", None), ("tool", "甲山县食品安全管理规定条例", "甲山县", "2010-05-01", None), ("undated", "乙水市旅游促进条例", "乙水市", None, "2015-03-01"),
        ("torn", "甲山县食品安全管理办法", "甲山县", None, None), ("null", None, "甲山县", "2010-05-01", None), (None, "甲山县食品安全管理办法", "甲山县", "2010-05-01", None), ("same", "甲山县食品安全管理办法", "甲山县", "2010-05-01", None),
    ]
    one = "甲山县食品安全管理办法_20100501.md"
    assert found(spark, rows) == sorted([("same", one), ("late", one), ("swap", one), ("trad", one), ("lost", one), ("moved", one), ("undated", "乙水市旅游促进条例_20150101.md")])


def test_errors_at_the_head_of_a_title(spark):
    base = [("甲山县食品安全管理办法", "2010-05-01", None), ("甲山县供水条例", "2010-05-01", None)]
    rows = [("swapped", "甲山县食安品全管理办法", "甲山县", "2010-05-01", None), ("two", "甲山县品食全安管理办法", "甲山县", "2010-05-01", None), ("twice", "甲山县食食品安安全管理办法", "甲山县", "2010-05-01", None),
            ("short", "甲山县水供例条", "甲山县", "2010-05-01", None), ("none", "品食全安管理办法", "甲山县", None, None), ("far", "甲山县品食全安管理办法", "甲山县", "2011-05-01", None)]
    one, two = "甲山县食品安全管理办法_20100501.md", "甲山县供水条例_20100501.md"
    assert found(spark, rows, base) == sorted([("swapped", one), ("two", one), ("twice", one), ("short", two), ("none", one)])


def test_a_law_without_a_day_meets_dated_records(spark):
    base = [("甲山县供水管理办法", "", "2010-07-01"), ("甲山县旅游促进条例", "", None), ("甲山县殡葬管理规定", "", "2010-07-01")]
    rows = [("eff", "甲山县供水管理办法", "甲山县", "2010-05-01", "2010-07-01"), ("plain", "甲山县旅游促进条例", "甲山县", "2015-01-01", None), ("day", "甲山县殡葬管理规定", "甲山县", "2010-05-01", None),
            ("late", "甲山县殡葬管理规定", "甲山县", "2016-05-01", None), ("undated", "甲山县供水管理办法", "甲山县", None, "2010-07-01")]
    water, tour, burial = "甲山县供水管理办法_.md", "甲山县旅游促进条例_.md", "甲山县殡葬管理规定_.md"
    assert found(spark, rows, base) == sorted([("eff", water), ("plain", tour), ("day", burial), ("undated", water)])


def test_a_moved_character_beside_a_lost_or_doubled_one(spark):
    base = [("沐石坳县文物促进规定", "2002-11-06", None), ("沐石坳县旅游管理办法", "2002-11-06", None), ("沐石坳县供水设施保护办法", "2002-11-06", None)]
    rows = [("lost", "沐石坳县文物促定进", "沐石坳县", "2002-11-06", None), ("doubled", "沐石坳县旅游游理办管法", "沐石坳县", "2002-11-06", None), ("wrong", "沐石坳县供电设施养护规定", "沐石坳县", "2002-11-06", None)]
    assert found(spark, rows, base) == [("doubled", "沐石坳县旅游管理办法_20021106.md"), ("lost", "沐石坳县文物促进规定_20021106.md")]


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [("a", "甲山县供水管理办法", "甲山县", "2010-05-01", None)], []) == []


def plain_cost(a, b, alias):
    p = np.full((len(a) + 1, len(b) + 1), np.inf)
    p[0, 0] = 0
    same = lambda x, y: 0 if x == y else alias[x][1] if x in alias and alias[x][0] == y else np.inf
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                p[i, j] = min(p[i, j], p[i - 1, j] + (0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.2))
            if j:
                p[i, j] = min(p[i, j], p[i, j - 1] + 0.9)
            if i and j:
                p[i, j] = min(p[i, j], p[i - 1, j - 1] + min(2.1, same(a[i - 1], b[j - 1])))
            if i > 1 and j > 1 and a[i - 1] != b[j - 1]:
                p[i, j] = min(p[i, j], p[i - 2, j - 2] + 0.5 + same(a[i - 1], b[j - 2]) + same(a[i - 2], b[j - 1]))
    return p[-1, -1]


def test_edit_costs_against_the_plain_recursion():
    rng = np.random.default_rng(0)
    a = ["".join(rng.choice(list("甲乙丙丁"), rng.integers(0, 14))) for _ in range(400)]
    b = ["".join(rng.choice(list("甲乙丙丁"), rng.integers(0, 14))) for _ in range(400)]
    alias = {"丙": ("丁", 0.3), "甲": ("乙", 1.0)}
    got, want = K.edit_costs(a, b, alias), np.array([plain_cost(x, y, alias) for x, y in zip(a, b)])
    below = want < K.NO_TITLE
    assert np.allclose(got[below], want[below], atol=1e-3) and (got[~below] >= K.NO_TITLE - 1e-3).all() and len(K.edit_costs([], [])) == 0
    assert abs(K.edit_costs(["甲" * 3_000], ["甲" * 2_999 + "乙"])[0] - 1.4) < 1e-3


def test_alternating_directions_reach_the_optimum():
    rng = np.random.default_rng(1)
    n, m = 4, 9
    f = np.repeat(np.arange(m), 2)
    v = np.concatenate([rng.choice(n, 2, replace=False) for _ in range(m)])
    a, c, w = rng.choice([-1.0, 1.0], 2 * m), rng.uniform(-1, 1, m), rng.uniform(0.5, 3, m)
    y = K.HingeProblem(f, v, a, c, w, n).solve(rounds=4000, tolerance=1e-8, ridge=0.0)
    loss = lambda z: (w * np.maximum(0, np.add.reduceat(a * z[..., v], np.arange(0, 2 * m, 2), axis=-1) + c)).sum(-1)
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 21)] * n), -1).reshape(-1, n)
    assert loss(y) <= loss(grid).min() + 1e-3


PAIRS = "file string, bbbs string, title_sim double, date_sim double, place_sim double, at int, alike double"


def scored(rng, n):
    """A long chain of laws and records with links among the records of a law."""
    rows, at = [], {}
    for i in range(n):
        f, b = f"f{i // 3}", f"b{(i + rng.integers(2)) // 2}"
        if (f, b) not in {(r[0], r[1]) for r in rows}:
            at[f] = at.get(f, 0) + 1
            rows.append((f, b, *(float(x) for x in rng.uniform(0.4, 1, 3).round(3)), at[f], float(rng.choice([0.0, 0.6, 0.95])) if at[f] > 1 else 0.0))
    return rows


def test_rounds_over_partitions_agree_with_one_task(spark):
    pairs = spark.createDataFrame(scored(np.random.default_rng(5), 60), PAIRS)
    whole = {(r.file, r.bbbs): r.confidence for r in K.confidences(pairs).collect()}
    rounds = {(r.file, r.bbbs): r.confidence for r in K.confidences(pairs, in_task=1).collect()}
    assert whole.keys() == rounds.keys() and len(whole) > 30 and max(abs(whole[k] - rounds[k]) for k in whole) < 0.02


def test_components(spark):
    chain = [(f"f{i:02d}", f"b{i + j:02d}", 0.5, 0.5, 1.0, j + 1, 0.0) for i in range(30) for j in range(2)] + [("g", "c", 0.5, 0.5, 1.0, 1, 0.0)]
    got = {(r.file, r.bbbs): r.comp for r in K.components(spark.createDataFrame(chain, PAIRS)).collect()}
    assert len(set(got.values())) == 2 and len({c for (f, _), c in got.items() if f != "g"}) == 1


def without(rows):
    """What the rules on single pairs would say."""
    return {(r[0], r[1]): max(0.0, r[2] + r[3] + r[4] - 2) for r in rows}


def test_exclusivity_and_transitivity_decide():
    # one undated record before two versions of a law; a damaged record beside a clean one of the same law and time
    rows = [("v1", "x", 1.0, 0.9, 1.0, 1, 0.0), ("v2", "x", 1.0, 0.9, 1.0, 1, 0.0), ("f", "clean", 1.0, 1.0, 1.0, 1, 0.0), ("f", "torn", 0.72, 0.72, 1.0, 2, 0.9)]
    pdf = pd.DataFrame(rows, columns=["file", "bbbs", "title_sim", "date_sim", "place_sim", "at", "alike"])
    got = {(r.file, r.bbbs): r.confidence for r in K.resolve(pdf).itertuples()}
    alone = without(rows)
    assert {k for k, v in alone.items() if v > 0.5} == {("v1", "x"), ("v2", "x"), ("f", "clean")}
    assert {k for k, v in got.items() if v > 0.5} == {("f", "clean"), ("f", "torn")}
    assert abs(got["v1", "x"] - 0.5) < 0.02 and abs(got["v2", "x"] - 0.5) < 0.02


def test_misread_characters_are_fitted_and_ordinary_ones_are_not(spark):
    rng = np.random.default_rng(3)
    subject = ["供水", "供热", "旅游", "殡葬", "消防", "气象"]
    place = [f"{a}{b}县" for a in "甲乙丙丁戊己庚" for b in "山水石林川"]
    base = [(f"{p}{rng.choice(subject)}管理办法", f"20{y:02d}-05-01", None) for p in place for y in range(0, 20, 4)]
    rows = [(f"n{i}", t.replace("管", "菅") if i % 3 == 0 else t.replace("理办法", "理力发") if i % 3 == 1 else t, t[:3], d, None) for i, (t, d, _) in enumerate(base)]
    rows += [(f"x{i}", t[:3] + s + t[5:], t[:3], d, None) for i, (t, d, _) in enumerate(base) for s in [str(rng.choice([s for s in subject if s != t[3:5]]))]]
    law, rec = staged(K.laws(laws(spark, base)), "l"), staged(K.records(local(spark, rows)), "r")
    table = K.read_as(K.attributed(K.candidates(law, rec), law, rec))
    assert {k: v[0] for k, v in table.items() if v[1] < 1} == {"菅": "管", "力": "办", "发": "法"}
    got = {b for b, _ in found(spark, rows, base)}
    assert {f"n{i}" for i in range(len(base))} == got


def test_candidates_lose_nothing_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    subject, tool = ["供水", "食品安全", "旅游", "殡葬"], ["管理办法", "促进条例", "管理若干规定"]
    base = [(f"{p}县{rng.choice(subject)}{rng.choice(tool)}", f"20{rng.integers(10):02d}-0{rng.integers(1, 10)}-01", None) for p in ("甲山", "乙水", "丙石坳") for _ in range(12)]
    base = list({(t, d): (t, d, e) for t, d, e in base}.values())
    rows = []
    for i, (t, d, _) in enumerate(base):
        cut = int(rng.integers(len(t)))
        noisy = [t[:cut] + t[cut + 1 :], t[:cut] + t[cut : cut + 1] + t[cut:], t + "（20 10年修" + "）订", t.replace("县", "", 1)][i % 4]
        rows.append((f"r{i}", noisy, None if i % 5 == 0 else t[:3], d if i % 7 else None, None))
    law, rec = staged(K.laws(laws(spark, base)), "l"), staged(K.records(local(spark, rows)), "r")
    every = law.select("file").crossJoin(rec.select("bbbs"))
    sure = lambda pairs: {(r.file, r.bbbs) for r in K.confidences(K.scored(K.attributed(pairs, law, rec), rec)).filter("confidence > 0.5").collect()}
    assert sure(K.candidates(law, rec)) == sure(every)


def test_places_named_wrongly_or_not_at_all(spark):
    base = [("瑶兰湾县市政管理暂行办法", "2013-02-10", None), ("甲山县供水管理办法", "2010-05-01", None), ("乙水县供水管理办法", "2010-05-01", None)]
    rows = [("short", "瑶兰湾市政管理暂行办法", None, "2013-02-20", None), ("wrong", "甲山县供水管理办法", "丙石县", "2010-05-01", None), ("none", "供水管理办法", None, "2010-05-01", None), ("other", "供水管理办法", "丙石县", "2010-05-01", None)]
    assert found(spark, rows, base) == [("short", "瑶兰湾县市政管理暂行办法_20130210.md"), ("wrong", "甲山县供水管理办法_20100501.md")]
