"""Pairs of texts of which one holds the other, found by the rarest piece and not by comparing all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.session import staged

PIECE = 4


def _cut(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substr(c, i, F.lit(n)))


def containing(outer: DataFrame, inner: DataFrame, piece: int = PIECE) -> DataFrame:
    """o, i of all pairs in which the text o holds the text i. outer: a column o, inner: a column i; repeated, null and
    empty texts count for nothing.

    A text that holds another holds all its pieces, so it is enough to look at the piece of i that the fewest texts hold;
    one that none holds rules i out. Texts shorter than a piece are looked up whole, with pieces of their own length.
    """
    outer = staged(outer.select("o").filter("o <> ''").distinct(), "outer")
    inner = inner.select("i").filter("i <> ''").distinct().withColumn("n", F.least(F.length("i"), F.lit(piece)))
    inner = staged(inner, "inner")
    sizes = [r.n for r in inner.select("n").distinct().collect()]  # at most `piece`
    none = F.lit(None).cast("string")
    held = outer.select("o", F.explode(F.array_distinct(F.concat(*[_cut(F.col("o"), n) for n in sizes])))) if sizes else outer.select("o", none)
    held = held.toDF("o", "p")
    known = held.groupBy("p").agg(F.count("*").alias("df"))
    own = F.array_distinct(F.coalesce(*[F.when(F.col("n") == n, _cut(F.col("i"), n)) for n in sizes])) if sizes else F.array(none)
    each = inner.select("i", F.explode(own).alias("p")).join(known, "p", "left")
    rarest = each.groupBy("i").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "p")).alias("m")).filter("m.df > 0").select("i", F.col("m.p").alias("p"))
    return held.join(rarest, "p").filter(F.contains("o", F.col("i"))).select("o", "i")
