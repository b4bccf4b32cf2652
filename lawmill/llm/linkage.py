"""Matching entities across sources without keys, by soft-logic linkage.

Candidates share pieces of their titles, the rarest that a record has, within neighbouring stretches of time. Each is a
variable between 0 and 1; weighted rules on the similarities of title, date and place, the exclusivity of a record and
the transitivity among alike records of one law become hinge losses of linear terms. The convex problem falls apart
into the connected components of the candidates. It is solved by alternating directions on consensus copies of the
variables: many small components at once in a task, components beyond a bound in rounds over partitions. A variable's
value is the confidence of its pair; no threshold on a similarity stands before the solver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.functions.text import iso_date, stripped, without_tags
from lawmill.llm.lookalike import consistent_form
from lawmill.session import parallelism, staged

_BODY = "(人民代表大会常务委员会|人民代表大会|人大常务委员会|人大常委会|人大|人民政府办公厅|人民政府办公室|人民政府)$"
_PLACE = "^(.{1,8}?(?:自治县|自治州|自治区|市|县|区))"
_PLACE_END = "(自治县|自治州|自治区|市|县|区)$"
_WRAPPED = "^关于(?:印发|公布|发布|颁布|实施|施行)(.+)的(?:公告|通知|决定|命令)$"
#: A note on the version at the end of a title, also where a character of it was lost, moved or doubled.
_VERSION = r"(?:[0-9]*[（(][^0-9]*[0-9].*|[0-9]{2,4}年.{0,3}[）)]?)$"

#: Rarest known pieces of a record's title that make candidates: a law is one if it lacks fewer of the record's known pieces.
PIECES = 6
#: Days of a stretch; dates up to as far apart always meet, those beyond twice as far never.
STRETCH = 96
#: What edit_costs counts: another character in its place, a strange, a lost, a doubled one, a swap of neighbours.
OTHER, STRANGE, LOST, DOUBLED, SWAPPED = 2.1, 1.2, 0.9, 0.5, 0.5
#: Cost of a title that has all its characters, some of them moved further than one place.
MOVED = 1.0
#: Cost at which titles have nothing in common, and days at which dates have not.
NO_TITLE, NO_DATE = 4.0, 183
#: Days between two records of one law from which on they say nothing about each other.
SAME_TIME = 45
#: The fit of what characters are read for others: imagined sightings of a character as itself, sightings it needs, and the
#: cost of one that is always read so.
READ_AS_ITSELF, LEAST_SEEN, MISREAD = 1, 2, 0.1
#: Candidate pairs of a component that one task solves; larger components are solved in rounds over partitions.
PAIRS_IN_TASK = 20_000
#: Candidate pairs that one call solves, in whole components.
PAIRS_AT_ONCE = 50_000


def simplified_map(spark: SparkSession) -> tuple[str, str]:
    """Traditional characters and their simplified forms, by the transliterator that comes with Spark."""
    kind = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    chars = "".join(map(chr, range(0x4E00, 0xA000)))
    pairs = [(a, b) for a, b in zip(chars, kind.transliterate(" ".join(chars)).split(" "), strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def bare_title(c: Column) -> Column:
    """A title without markup, blanks, invisible characters, book marks, dots, a wrapping announcement and a version note."""
    t = F.regexp_replace(without_tags(c), r"[\s\p{Z}\p{Cf}­·•・‧《》〈〉]", "")
    for pattern, left in 2 * ((_WRAPPED, "$1"), (_VERSION, "")):
        t = F.regexp_replace(t, pattern, left)
    return t


def _day(c: Column) -> Column:
    return F.unix_date(F.try_to_date(iso_date(c), "yyyy-MM-dd"))


def _issuer_place(c: Column) -> Column:
    return F.when(c.rlike(_BODY), F.regexp_replace(c, _BODY, ""))


def laws(df: DataFrame) -> DataFrame:
    """One row per file: file, title, place, short, core, day, effs. Attributes are the latest non-void ones of its rows;
    a day that no row holds is taken from the file's name."""
    fold = simplified_map(df.sparkSession)
    shown = consistent_form(df.select("file", "title", "promulgated", "effective", "issuer", "loaded_at").filter("file is not null"), {"title": "form"})
    rows = shown.select(
        "file", "loaded_at", F.nullif(bare_title(F.col("form")), F.lit("")).alias("title"), _day(F.col("promulgated")).alias("day"),
        _day(F.col("effective")).alias("eff"), F.nullif(stripped(F.col("issuer")), F.lit("")).alias("issuer"),
    )
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("loaded_at", c)))[c].alias(c)
    one = rows.groupBy("file").agg(last("title"), last("day"), last("issuer"), F.array_compact(F.array(F.min("eff"), F.max("eff"), last("eff"))).alias("effs"))
    named = F.unix_date(F.try_to_date(F.regexp_extract("file", r"_(\d{8})\.\w+$", 1), "yyyyMMdd"))
    title = F.coalesce("title", F.nullif(bare_title(F.regexp_extract("file", r"([^/]*?)(?:_\d{8})?\.\w+$", 1)), F.lit("")))
    place = F.coalesce(_issuer_place(F.col("issuer")), F.nullif(F.regexp_extract("title", _PLACE, 1), F.lit("")), F.lit(""))
    one = one.withColumn("title", title).filter("title is not null").withColumn("place", place)
    one = one.select("file", F.translate("title", *fold).alias("title"), F.translate("place", *fold).alias("place"), F.coalesce("day", named).alias("day"), "effs")
    return one.withColumn("short", F.regexp_replace("place", _PLACE_END, "")).withColumn("core", _without_place(F.col("title"), F.col("place"), F.col("short")))


def _without_place(title: Column, place: Column, short: Column) -> Column:
    """The title without the place at its head, in full or short."""
    cut = F.when(F.startswith(title, place), F.substr(title, F.length(place) + 1)).when((F.length(short) > 1) & F.startswith(title, short), F.substr(title, F.length(short) + 1))
    return F.coalesce(cut, title)


def records(df: DataFrame) -> DataFrame:
    """One row per bbbs: bbbs, title, said (its place by region, else by issuer), day, eff, year; of repeated records the
    one fetched last counts."""
    fold = simplified_map(df.sparkSession)
    year = F.regexp_extract(F.regexp_replace(without_tags(F.col("title")), r"[\s\p{Z}\p{Cf}·《》]", ""), r"[（(]((?:19|20)\d{2})年?[^（()）]*[）)]$", 1)
    rows = df.filter("bbbs is not null and title is not null").select(
        "bbbs", "fetched_at", F.regexp_replace(bare_title(F.col("title")), "^[^省]{1,4}省", "").alias("title"), F.nullif(year, F.lit("")).try_cast("int").alias("year"),
        _day(F.col("promulgated")).alias("day"), _day(F.col("effective")).alias("eff"), F.nullif(stripped(F.col("region")), F.lit("")).alias("region"),
        F.nullif(stripped(F.col("issuer")), F.lit("")).alias("issuer"),
    )
    one = rows.groupBy("bbbs").agg(F.max(F.struct("fetched_at", "title", "year", "day", "eff", "region", "issuer")).alias("m")).select("bbbs", "m.*")
    said = F.coalesce("region", _issuer_place(F.col("issuer")))
    return one.select("bbbs", F.translate("title", *fold).alias("title"), F.translate(said, *fold).alias("said"), "day", "eff", "year").filter("title <> ''")


def _pieces(c: Column) -> Column:
    """The pairs of neighbouring characters of a text in either order, so that a swap keeps its pair; each once."""
    at = lambda i: F.substr(c, i, F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.concat(F.least(at(i), at(i + 1)), F.greatest(at(i), at(i + 1))))
    return F.array_distinct(pairs)


def _place_key(place: Column) -> Column:
    """A place without its kind; with it where nothing but one character would be left."""
    short = F.regexp_replace(place, _PLACE_END, "")
    return F.when(F.length(short) > 1, short).otherwise(place)


def candidates(law: DataFrame, rec: DataFrame, pieces: int = PIECES) -> DataFrame:
    """Pairs (file, bbbs) of one place, in the same or a neighbouring stretch of time, that share one of the record's
    `pieces` rarest known pieces. The places of a record are the one it names and those its title begins with; a record
    without any is compared by the pieces of its whole title, wherever a law is from.

    A piece that no law holds makes no candidates and does not count, so a law is found if it lacks fewer than `pieces`
    of the pieces of the record that any law holds. A law without a day meets all records, an undated record all laws.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    undated, unknown = F.lit(-(2**40)), F.lit(-(2**41))  # slots of records and of laws without a day
    law_slots = F.array(undated, F.coalesce(stretch("day"), unknown))
    rec_slots = F.when(F.col("day").isNull(), F.array(undated)).otherwise(F.array(stretch("day") - 1, stretch("day"), stretch("day") + 1, unknown))

    def meet(held: DataFrame, asked: DataFrame) -> DataFrame:
        """held: file, day, key, piece; asked: bbbs, day, key, text."""
        known = held.groupBy("piece").agg(F.count("*").alias("df"))
        each = asked.withColumn("piece", F.explode(_pieces(F.col("text"))))
        few = each.join(known, "piece").groupBy("bbbs", "day", "key").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "piece"))), 1, pieces).alias("few"))
        rk = few.select("key", F.explode("few.piece").alias("piece"), "day", "bbbs").select("key", "piece", F.explode(rec_slots).alias("slot"), "bbbs")
        lk = held.select("key", "piece", F.explode(law_slots).alias("slot"), "file")
        return lk.join(rk, ["key", "piece", "slot"]).select("file", "bbbs")

    keyed = law.withColumn("key", _place_key(F.col("place")))
    longest = keyed.agg(F.max(F.length("key")).alias("n")).first()["n"] or 1
    heads = rec.select("bbbs", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.left("title", n))).alias("key")).distinct()
    places = heads.join(keyed.select("key").filter("key <> ''").distinct(), "key", "left_semi").unionByName(rec.filter("said is not null").select("bbbs", _place_key(F.col("said")).alias("key"))).distinct()
    rest = F.when(F.startswith("title", "key"), F.regexp_replace(F.substr("title", F.length("key") + 1), "^" + _PLACE_END[:-1], "")).otherwise(F.col("title"))
    at_home = meet(
        keyed.select("file", "day", "key", F.explode(_pieces(F.col("core"))).alias("piece")), rec.join(places, "bbbs").select("bbbs", "day", "key", rest.alias("text"))
    )
    whole = F.array_distinct(F.concat(_pieces(F.concat("place", "core")), _pieces(F.concat("short", "core"))))
    elsewhere = meet(
        law.select("file", "day", F.lit("").alias("key"), F.explode(whole).alias("piece")), rec.join(places, "bbbs", "left_anti").select("bbbs", "day", F.lit("").alias("key"), F.col("title").alias("text"))
    )
    return at_home.unionByName(elsewhere).distinct()


def read_as(pairs: DataFrame) -> dict[str, tuple[str, float]]:
    """What characters of records are misread for: {character: (the true one, cost)}, fitted on all candidate pairs.

    Of each record the pair counts whose titles are of equal length, differ in the fewest places and in at most a third
    of them and 3. A character is read as another in the share of all its places in which the law has that other;
    the cost goes down with that share. One partner a character, so the table is bounded by the characters there are.
    """
    rest = _without_place(F.col("r_title"), F.col("place"), F.col("short"))
    n = F.length("core")
    both = F.arrays_zip(F.split(rest, "").alias("r"), F.split(F.col("core"), "").alias("l"))
    differ = F.size(F.filter("both", lambda x: x["r"] != x["l"]))
    even = pairs.filter(F.length(rest) == n).select("bbbs", "file", n.alias("n"), both.alias("both")).withColumn("differ", differ).filter((F.col("differ") <= 3) & (F.col("differ") * 3 <= F.col("n")))
    best = even.groupBy("bbbs").agg(F.min(F.struct("differ", "file", "both")).alias("b"))
    seen = best.select(F.explode("b.both").alias("x")).groupBy("x.r", "x.l").agg(F.count("*").alias("times"))
    share = F.col("times") / (F.sum("times").over(W.partitionBy("r")) + READ_AS_ITSELF)
    top = seen.withColumn("share", share).filter(f"r <> l and share >= 0.1 and times >= {LEAST_SEEN}").groupBy("r").agg(F.max(F.struct("share", "l")).alias("m"))
    return {x.r: (x.l, round(OTHER - (OTHER - MISREAD) * x.share, 3)) for x in top.select("r", "m.l", "m.share").collect()}


def edit_costs(a: list[str], b: list[str], alias: dict[str, tuple[str, float]] | None = None) -> np.ndarray:
    """How much noise turns the true text b into a, for many pairs at once: a swap of neighbours or a doubled character
    costs 0.5, a lost one 0.9, a strange one 1.2, another in its place 2.1 or what alias says; inf at NO_TITLE and above
    where the texts differ so much in length that no path stays below it."""
    most_lost, most_more = int(NO_TITLE / LOST), int(NO_TITLE / DOUBLED)
    out, pairs, none = np.full(len(a), np.inf), list(zip(a, b, strict=True)), np.float32(np.inf)
    alias = alias or {}
    fit = sorted((i for i, (s, t) in enumerate(pairs) if -most_lost <= len(s) - len(t) <= most_more), key=lambda i: len(pairs[i][1]))
    width = most_lost + most_more + 1
    while fit:
        size = max(1, 2_000_000 // (len(pairs[fit[-1]][1]) + most_more + 1))
        part, fit = fit[-size:], fit[:-size]
        n = len(part)
        la, lb = np.array([len(pairs[i][0]) for i in part]), np.array([len(pairs[i][1]) for i in part])
        x, y = np.zeros((la.max() + 1, n), dtype=np.int32), np.full((lb.max() + width + 1, n), -1, dtype=np.int32)
        other, price = np.zeros_like(x), np.full(x.shape, OTHER, dtype=np.float32)
        for c, i in enumerate(part):
            s, t = pairs[i]
            x[: len(s), c] = np.frombuffer(s.encode("utf-32-le"), dtype=np.int32)
            y[: len(t), c] = np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
        for r, (true, cost) in alias.items():
            at = x == ord(r)
            if at.any():
                other[at], price[at] = ord(true), cost
        done, rows = np.full(n, np.inf, dtype=np.float32), []
        for i in range(la.max() + 1):
            row = np.full((width, n), np.inf, dtype=np.float32)  # row[k]: j = i - most_more + k characters of b
            for k in range(width):
                j = i - most_more + k
                if j < 0 or j > lb.max():
                    continue
                if not i and not j:
                    row[k] = 0
                    continue
                best = row[k - 1] + np.float32(LOST) if j and k else np.full(n, np.inf, dtype=np.float32)
                if i and k + 1 < width:
                    doubled = (x[i - 1] == x[i - 2]) if i > 1 else np.zeros(n, bool)
                    best = np.minimum(best, rows[-1][k + 1] + np.where(doubled, np.float32(DOUBLED), np.float32(STRANGE)))
                if i and j:
                    s, t = x[i - 1], y[j - 1]
                    best = np.minimum(best, rows[-1][k] + np.where(s == t, np.float32(0), np.where(other[i - 1] == t, price[i - 1], np.float32(OTHER))))
                    if i > 1 and j > 1:
                        first = np.where(s == y[j - 2], np.float32(0), np.where(other[i - 1] == y[j - 2], price[i - 1], none))
                        second = np.where(x[i - 2] == t, np.float32(0), np.where(other[i - 2] == t, price[i - 2], none))
                        best = np.minimum(best, rows[-2][k] + np.where(s != t, first + second + np.float32(SWAPPED), none))
                row[k] = best
            at = np.flatnonzero(la == i)
            done[at] = row[lb[at] - i + most_more, at]
            rows = [*rows[-1:], row]
        out[part] = np.round(done, 3)
    return out


def _moved_cost(a: str, b: str, cost: float) -> float:
    """The cost of a as noise of b, where it can be a character moved further than one place: alone, or beside one that
    was lost or doubled, which counts as its own small error."""
    lost, strange = Counter(b) - Counter(a), Counter(a) - Counter(b)
    if not lost and not strange:
        return min(cost, MOVED)
    if not strange and lost.total() == 1:
        return min(cost, MOVED + LOST)
    if not lost and strange.total() == 1 and 2 * next(iter(strange)) in a:
        return min(cost, MOVED + DOUBLED)
    return cost


def _similarities(pdf: pd.DataFrame, alias: dict[str, tuple[str, float]]) -> pd.DataFrame:
    """Similarities between 0 and 1 of title, date and place of candidate pairs.

    A record's title is compared with the law's with its place, with the place in short, and without; where it fits best
    without, the record's own words on its place are asked.
    """
    n, r = len(pdf), pdf["r_title"].tolist()
    forms = [[p + c for p, c in zip(pdf[h], pdf["core"], strict=True)] for h in ("place", "short")] + [pdf["core"].tolist()]
    costs = np.stack([edit_costs(r, f, alias) for f in forms])
    for k, i in zip(*np.nonzero((costs > MOVED) & (costs <= OTHER + 2 * STRANGE)), strict=True):
        costs[k, i] = _moved_cost(r[i], forms[k][i], costs[k, i])
    best, cost = costs.argmin(axis=0), costs.min(axis=0)
    said = pdf["said"].to_numpy(dtype=object)
    known, same = ~pdf["said"].isna().to_numpy(), said == pdf["place"].to_numpy(dtype=object)
    home = pdf["place"].to_numpy(dtype=object) != ""
    titled = (best < 2) & home
    place = np.where(titled, np.where(known & ~same, 0.8, 1.0), np.where(known, np.where(same, 1.0, 0.0), np.where(home, 0.6, 1.0)))
    gap = np.abs(pdf["r_day"] - pdf["l_day"]).to_numpy(dtype=float)
    dated = np.clip(1 - np.maximum(0, gap - 3) / (NO_DATE - 3), 0, 1)
    guess = np.full(n, 0.9)
    for i in np.flatnonzero(np.isnan(gap)):
        eff, effs, year, day = pdf["eff"].iat[i], pdf["effs"].iat[i], pdf["year"].iat[i], pdf["l_day"].iat[i]
        effs, own = [] if effs is None else [e for e in effs if e is not None], pdf["r_day"].iat[i]
        if not pd.isna(eff):
            off = min((abs(eff - e) for e in effs), default=None)
            later = None if pd.isna(day) else eff - day
            if off is not None and off <= 3:
                guess[i] = 0.95
            elif later is not None:
                guess[i] = 0.85 if -3 <= later <= 200 else 0.2
            elif off is not None:
                guess[i] = 0.7 if off <= 120 else 0.2
        elif not pd.isna(own) and effs:  # the law has no day
            guess[i] = 0.85 if any(-3 <= e - own <= 200 for e in effs) else 0.2
        elif not pd.isna(year) and not pd.isna(day):
            known_year = (np.datetime64("1970-01-01") + np.timedelta64(int(day), "D")).astype("datetime64[Y]").astype(int) + 1970
            guess[i] = 0.9 if known_year == year else 0.8 if abs(known_year - year) == 1 else 0.2
    return pd.DataFrame({
        "file": pdf["file"], "bbbs": pdf["bbbs"], "title_sim": np.clip(1 - cost / NO_TITLE, 0, 1), "date_sim": np.where(np.isnan(gap), guess, dated), "place_sim": place,
    })


@dataclass
class HingeProblem:
    """sum of weight * max(0, coefficients . y + constant) over factors, y in [0, 1]; an infinite weight is a constraint.

    A factor's entries are (factor, variable, coefficient). Solved by alternating directions: each factor has its own
    copies of its variables, pulled to their mean. RIDGE / 2 * y**2 is added, which is too little to move a variable off
    the bend of a hinge and lets variables that are equally good share evenly.
    """

    factor: np.ndarray
    variable: np.ndarray
    coefficient: np.ndarray
    constant: np.ndarray
    weight: np.ndarray
    variables: int

    def solve(self, rho: float = 1.0, rounds: int = 400, tolerance: float = 1e-5, ridge: float | None = None) -> np.ndarray:
        f, v, a = self.factor, self.variable, self.coefficient
        norm, ridge = np.bincount(f, a * a, len(self.constant)), RIDGE if ridge is None else ridge
        copies = np.maximum(1, np.bincount(v, minlength=self.variables))
        z, u = np.full(self.variables, 0.5), np.zeros(len(v))
        for _ in range(rounds):
            at = z[v] - u
            value = np.bincount(f, a * at, len(self.constant)) + self.constant
            step = np.where(value > 0, np.minimum(self.weight / rho, value / np.maximum(norm, 1e-12)), 0.0)
            x = at - a * step[f]
            new = np.clip(np.bincount(v, x + u, self.variables) / (copies + ridge / rho), 0, 1)
            u += x - new[v]
            moved, z = np.abs(new - z).max(initial=0), new
            if moved < tolerance and np.abs(x - z[v]).max(initial=0) < 10 * tolerance:
                break
        return z


#: Weights of the rules; exclusivity is a constraint. Two alike neighbours together weigh less than a pair's own agreement and more
#: than the prior, so they can lift a pair with weak evidence and never undo one with good evidence.
AGREE, PRIOR, TITLE, DATE, PLACE, TRANSITIVE, RIDGE = 4.0, 0.5, 6.0, 6.0, 6.0, 1.2, 0.2


def _rules(t, d, p) -> list[tuple[float, object, float]]:
    """The rules on one pair as (coefficient of y, constant, weight)."""
    return [
        (-1.0, t + d + p - 2, AGREE),  # title, date and place agree -> same
        (1.0, 0 * t, PRIOR),  # not the same unless there is a reason
        (1.0, -1 * t, TITLE),  # titles differ -> not the same
        (1.0, -1 * d, DATE),  # dates differ -> not the same
        (1.0, -1 * p, PLACE),  # places differ -> not the same
    ]


def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Confidence of the pairs of whole components: file, at (order within the file), bbbs, the similarities, and alike
    (of the pair's record with that of the pair before it in the file, 0 where there is none)."""
    pdf = pdf.sort_values(["file", "at"]).reset_index(drop=True)
    n, i = len(pdf), np.arange(len(pdf))
    groups = [(i[:, None], np.full((n, 1), c), np.asarray(k, dtype=float), np.full(n, w)) for c, k, w in _rules(*(pdf[s].to_numpy() for s in ("title_sim", "date_sim", "place_sim")))]
    alike = pdf["alike"].to_numpy()
    link = np.flatnonzero(alike > 0)
    for p, q in ((link - 1, link), (link, link - 1)):  # alike records and the one is the law -> the other too
        groups.append((np.stack([p, q], 1), np.tile([1.0, -1.0], (len(p), 1)), alike[link] - 1, np.full(len(link), TRANSITIVE)))
    factor = np.concatenate([np.repeat(np.arange(len(g[2])), g[0].shape[1]) + sum(len(h[2]) for h in groups[:k]) for k, g in enumerate(groups)])
    total = sum(len(g[2]) for g in groups)
    owner, record = np.unique(pdf["bbbs"].to_numpy(), return_inverse=True)  # a record stands for one law
    problem = HingeProblem(
        np.concatenate([factor, record + total]), np.concatenate([*(g[0].ravel() for g in groups), i]), np.concatenate([*(g[1].ravel() for g in groups), np.ones(n)]),
        np.concatenate([*(g[2] for g in groups), -np.ones(len(owner))]), np.concatenate([*(g[3] for g in groups), np.full(len(owner), np.inf)]), n,
    )
    return pdf[["file", "bbbs"]].assign(confidence=np.round(problem.solve(), 3))


def resolve_in_rounds(pairs: DataFrame, rounds: int = 400, at_once: int = 4, tolerance: float = 1e-4) -> DataFrame:
    """The same as resolve for components of any size: each round of alternating directions is a window over the pairs of
    a law, for rules and transitivity, and one over those of a record, for exclusivity. Pairs keep their copies of the
    variables in columns; every `at_once` rounds they are written to the shared folder, which cuts the lineage."""
    rules = _rules(F.col("title_sim"), F.col("date_sim"), F.col("place_sim"))
    names = [f"v{k}" for k in range(len(rules))] + ["e", "m1", "m2"]  # own copies: rules, exclusivity, two links with the pair before
    theirs = ["p1", "p2"]  # copies of the variable before, in those two links
    by_law, by_record = W.partitionBy("file").orderBy("at"), W.partitionBy("bbbs")
    zero = F.lit(0.0)
    now = pairs.select("file", "at", "bbbs", "title_sim", "date_sim", "place_sim", "alike", F.lit(0.5).alias("z"), F.lit(0.5).alias("before"), *[F.lit(0.5).alias(c) for c in (*names, *theirs)])
    linked = F.col("alike") > 0
    for lap in range(-(-rounds // at_once)):
        for _ in range(at_once):
            # a copy's multiplier is u = v - z of the round before, where v is the copy plus the old multiplier: at = z - u
            u = {c: F.col(c) - F.col("z") for c in names} | {c: F.col(c) - F.col("before") for c in theirs}
            own = {c: F.col("z") - u[c] for c in names} | {c: F.col("before") - u[c] for c in theirs}
            now = now.select("*", *[own[c].alias(f"at_{c}") for c in own], *[u[c].alias(f"u_{c}") for c in own])
            new = {}
            for k, (c, constant, weight) in enumerate(rules):
                value = F.lit(c) * F.col(f"at_v{k}") + constant
                new[f"v{k}"] = F.col(f"at_v{k}") - F.lit(c) * F.greatest(zero, F.least(F.lit(weight), value)) + F.col(f"u_v{k}")
            for m, p, sign in (("m1", "p1", 1.0), ("m2", "p2", -1.0)):  # sign * (before - own) + alike - 1
                value = F.lit(sign) * (F.col(f"at_{p}") - F.col(f"at_{m}")) + F.col("alike") - 1
                step = F.when(linked, F.greatest(zero, F.least(F.lit(TRANSITIVE), value / 2))).otherwise(0.0)
                new[m] = F.col(f"at_{m}") + F.lit(sign) * step + F.col(f"u_{m}")
                new[p] = F.col(f"at_{p}") - F.lit(sign) * step + F.col(f"u_{p}")
            over = F.greatest(zero, (F.sum("at_e").over(by_record) - 1) / F.count("*").over(by_record))
            new["e"] = F.col("at_e") - over + F.col("u_e")
            now = now.select("file", "at", "bbbs", "title_sim", "date_sim", "place_sim", "alike", F.col("z").alias("old"), *[v.alias(c) for c, v in new.items()])
            follows = F.coalesce(F.lead("alike").over(by_law), zero) > 0
            sums = reduce(lambda a, b: a + b, [F.col(f"v{k}") for k in range(len(rules))]) + F.col("e") + F.when(linked, F.col("m1") + F.col("m2")).otherwise(0.0)
            sums += F.when(follows, F.lead("p1").over(by_law) + F.lead("p2").over(by_law)).otherwise(0.0)
            count = F.lit(len(rules) + 1 + RIDGE) + F.when(linked, 2).otherwise(0) + F.when(follows, 2).otherwise(0)
            now = now.withColumn("z", F.greatest(zero, F.least(F.lit(1.0), sums / count)))
            now = now.withColumn("before", F.coalesce(F.lag("z").over(by_law), F.lit(0.5)))
        now = staged(now, "round")
        if now.agg(F.max(F.abs(F.col("z") - F.col("old"))).alias("m")).first()["m"] < tolerance:
            break
        now = now.drop("old")
    return now.select("file", "bbbs", F.round("z", 3).alias("confidence"))


def components(pairs: DataFrame) -> DataFrame:
    """pairs with a column comp, equal within connected components. The smallest label spreads among the pairs of a record
    and of a law, then labels take the label of their own law, so that rounds grow with the logarithm of a path."""
    now = staged(pairs.withColumn("own", F.xxhash64("file")).withColumn("comp", F.col("own")), "comp")
    while True:
        by_rec = now.withColumn("m", F.min("comp").over(W.partitionBy("bbbs")))
        by_law = staged(by_rec.withColumn("m", F.min("m").over(W.partitionBy("file"))), "comp")
        if not by_law.filter("m <> comp").limit(1).count():
            return by_law.drop("m", "own")
        jump = by_law.groupBy(F.col("own").alias("m")).agg(F.min("m").alias("further"))
        now = staged(by_law.join(jump, "m", "left").withColumn("comp", F.least("m", "further")).drop("m", "further"), "comp")


def attributed(pairs: DataFrame, law: DataFrame, rec: DataFrame) -> DataFrame:
    """Candidate pairs with what their similarities are made of."""
    found = pairs.join(law.select("file", "place", "short", "core", F.col("day").alias("l_day"), "effs"), "file")
    return found.join(rec.select("bbbs", F.col("title").alias("r_title"), "said", F.col("day").alias("r_day"), "eff", "year"), "bbbs")


def scored(found: DataFrame, rec: DataFrame) -> DataFrame:
    """Pairs with their similarities, those of 0 left out, their order within the file and how alike their record is to
    the one before it: by title and date, 0 where one of them is undated."""
    alias = read_as(found)
    schema = "file string, bbbs string, title_sim double, date_sim double, place_sim double"
    sims = found.mapInPandas(lambda it: (_similarities(x, alias) for x in it if len(x)), schema).filter("title_sim > 0 and date_sim > 0 and place_sim > 0")
    order = W.partitionBy("file").orderBy(F.asc_nulls_last("day"), "bbbs")
    title, day = F.lag("title").over(order), F.lag("day").over(order)
    alike = (1 - F.levenshtein(F.col("title"), title) / NO_TITLE) * (1 - (F.col("day") - day) / SAME_TIME)
    alike = F.when((F.col("day") - day < SAME_TIME) & (F.levenshtein(F.col("title"), title) < NO_TITLE), F.round(alike, 6)).otherwise(0.0)
    return sims.join(rec.select("bbbs", "title", "day"), "bbbs").select("file", "bbbs", "title_sim", "date_sim", "place_sim", F.row_number().over(order).alias("at"), alike.alias("alike"))


def confidences(pairs: DataFrame, in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """Scored pairs with their confidence."""
    kept = components(pairs)
    big = staged(kept.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > in_task).select("comp"), "big")
    small = kept.join(big, "comp", "left_anti")
    buckets = max(parallelism(pairs.sparkSession), -(-kept.count() // PAIRS_AT_ONCE))
    solved = small.withColumn("bucket", F.pmod("comp", F.lit(buckets))).groupBy("bucket").applyInPandas(lambda p: resolve(p), "file string, bbbs string, confidence double")
    if big.limit(1).count():
        solved = solved.unionByName(resolve_in_rounds(kept.join(big, "comp", "left_semi")))
    return solved.join(kept.select("file", "bbbs", "title_sim", "date_sim", "place_sim"), ["file", "bbbs"])


def linked(downloads: DataFrame, local: DataFrame, in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """file, bbbs, confidence, title_sim, date_sim, place_sim for every candidate pair whose similarities are above 0.

    A pair with a similarity of 0 has confidence 0 in every optimum (no rule speaks for it), so leaving it out changes
    nothing. Defined cases: rows with a null file or bbbs, and records without a title, take no part; missing dates are
    judged by the date of effect, else by a year in the title, else neutrally; a record that names no place is
    judged by title and date and shares its confidence among the places that fit; repeated rows count once; a record
    that fits several laws equally well shares its confidence among them; empty tables give no pairs.
    """
    law = staged(laws(downloads), "laws")
    rec = staged(records(local), "records")
    found = staged(attributed(candidates(law, rec), law, rec), "candidates")
    return confidences(scored(found, rec), in_task)
