"""Retrieval quality: recall, hit and all-hit rates, mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 8, 10, 20, 50)


def answer_positions(results: DataFrame, questions: DataFrame, depth: int = max(KS)) -> DataFrame:
    """qid, kind, must, positions found, all_within (largest position, null if one is missing), first.

    results: qid, rank, law, article; questions: qid, kind, must_include, acceptable (arrays of law, article). The
    first position is that of any required article, else that of an acceptable one. Null arrays are empty; a required
    article named twice counts twice.
    """
    empty = F.expr("cast(array() as array<struct<law:string,article:string>>)")
    q = questions.select("qid", "kind", F.coalesce("must_include", empty).alias("must_include"), F.coalesce("acceptable", empty).alias("acceptable"))
    best = results.filter(F.col("rank") <= depth).groupBy("qid", "law", "article").agg(F.min("rank").alias("rank"))
    wanted = q.select("qid", F.posexplode("must_include").alias("i", "x")).select("qid", "i", "x.law", "x.article", F.lit(True).alias("must"))
    wanted = wanted.unionByName(q.select("qid", F.posexplode("acceptable").alias("i", "x")).select("qid", "i", "x.law", "x.article", F.lit(False).alias("must")))
    found = wanted.join(best, ["qid", "law", "article"], "left").groupBy("qid").agg(
        F.sort_array(F.collect_list(F.when(F.col("must"), F.col("rank")))).alias("positions"),
        F.min(F.when(F.col("must"), F.col("rank"))).alias("first_must"), F.min(F.when(~F.col("must"), F.col("rank"))).alias("first_ok"),
    )
    rows = q.select("qid", "kind", F.size("must_include").alias("must")).join(found, "qid", "left")
    positions = F.coalesce("positions", F.expr("cast(array() as array<int>)"))
    return rows.select(
        "qid", "kind", "must", positions.alias("positions"), F.when(F.size(positions) == F.col("must"), F.array_max(positions)).alias("all_within"),
        F.coalesce("first_must", "first_ok").alias("first"),
    )


def rates_at_k(positions: DataFrame) -> DataFrame:
    """k, recall (required articles found), hit (questions with any), all_hit (questions with all); only questions that
    require something count."""
    rows = positions.filter("must > 0").withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))
    within = F.size(F.filter("positions", lambda p: p <= F.col("k")))
    return rows.withColumn("within", within).groupBy("k").agg(
        F.round(F.sum("within") / F.sum("must"), 6).alias("recall"), F.round(F.avg((F.coalesce("first", F.lit(10**9)) <= F.col("k")).cast("int")), 6).alias("hit"),
        F.round(F.avg((F.coalesce("all_within", F.lit(10**9)) <= F.col("k")).cast("int")), 6).alias("all_hit"),
    )


def mean_reciprocal_rank(positions: DataFrame, cuts: tuple[int, ...] = (8, 20)) -> DataFrame:
    rows = positions.filter("must > 0").withColumn("cut", F.explode(F.array(*[F.lit(k) for k in cuts])))
    return rows.groupBy("cut").agg(F.round(F.avg(F.when(F.col("first") <= F.col("cut"), 1.0 / F.col("first")).otherwise(0.0)), 6).alias("mrr"))


def hits_by_kind(positions: DataFrame, k: int = 8) -> DataFrame:
    return positions.filter("must > 0").groupBy("kind").agg(F.count("*").alias("questions"), F.sum((F.coalesce("first", F.lit(10**9)) <= k).cast("long")).alias("hits"))


def hit_histogram(positions: DataFrame) -> DataFrame:
    """first (null: nothing found), questions."""
    return positions.filter("must > 0").groupBy("first").agg(F.count("*").alias("questions"))


def unknown_answers(questions: DataFrame, clauses: DataFrame) -> DataFrame:
    """qid, law, article of required articles that the corpus (law, article) does not hold."""
    wanted = questions.select("qid", F.explode("must_include").alias("x")).select("qid", "x.law", "x.article")
    return wanted.join(clauses.select("law", "article").distinct(), ["law", "article"], "left_anti").select("qid", "law", "article")
