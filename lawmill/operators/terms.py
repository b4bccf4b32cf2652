"""Questions as weighted search terms: phrases, character n-grams, expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters between segments, characters that make an n-gram worthless, weights and floors.
SEPARATOR = "[^一-鿿A-Za-z0-9]+"
STOP_CHARS = (
    "的了吗呢吧啊呀嘛么哦噢哟着过被把给让向从对以及就是有能可会要想之其此该等"
    "因为在就和与或而但也都很太更最只又再还是不各全同并且若如则由于到得地"
    "请 问怎什谁哪为个些这那我你他她它们"
)
PHRASE, GRAM, EXPANSION = "phrase", "gram", "expansion"
PHRASE_WEIGHT, EXPANSION_WEIGHT, LONGEST_PHRASE = 1.0, 0.8, 16
GRAMS = {4: (0.85, 2), 3: (0.65, 4), 2: (0.45, 8)}  # size: weight, least document frequency


def _grams(size: int) -> Column:
    """All n-grams of one size inside the segments, without those that hold a stop character."""
    long_enough = F.filter("segments", lambda s: F.length(s) >= size)
    grams = F.transform(long_enough, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - size + 1), lambda i: F.substr(s, i, F.lit(size))))
    return F.filter(F.flatten(grams), lambda g: ~g.rlike(f"[{STOP_CHARS}]"))


def build_terms(questions: DataFrame, qid: str, text: str, expansions: dict[str, list[str]] | None = None) -> DataFrame:
    """qid, term, weight, kind, min_df: each term of a question once, with its largest weight.

    Segments of letters, Han characters and digits up to 16 long are phrases; n-grams of 4, 3 and 2 characters inside
    segments count unless they hold a stop character; expansions count where their key occurs in the segments joined.
    There is no case folding. Null and empty questions have no terms; null ids are ignored; expansions whose key
    starts with an underscore are comments. Expansions are configuration and become literals of the plan.
    """
    segments = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATOR), lambda s: s != "")
    base = questions.filter(F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), segments.alias("segments"))
    term = lambda t, w, kind, floor: F.struct(t.alias("term"), F.lit(w).alias("weight"), F.lit(kind).alias("kind"), F.lit(floor).alias("min_df"))
    phrases = F.transform(F.filter("segments", lambda s: F.length(s) <= LONGEST_PHRASE), lambda s: term(s, PHRASE_WEIGHT, PHRASE, 1))
    parts = [phrases]
    for size, (weight, floor) in GRAMS.items():
        parts.append(F.transform(_grams(size), lambda g: term(g, weight, GRAM, floor)))  # noqa: B023
    pairs = [(k, v) for k, vs in (expansions or {}).items() if not k.startswith("_") and isinstance(vs, list) for v in vs]
    if pairs:
        joined = F.array_join("segments", "")
        table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
        parts.append(F.transform(F.filter(table, lambda e: F.contains(joined, e["k"])), lambda e: term(e["v"], EXPANSION_WEIGHT, EXPANSION, 1)))
    each = base.select("qid", F.explode(F.concat(*parts)).alias("t"))
    best = each.groupBy("qid", "t.term").agg(F.max(F.struct("t.weight", "t.kind", "t.min_df")).alias("b"))
    return best.select("qid", "term", "b.weight", "b.kind", "b.min_df")
