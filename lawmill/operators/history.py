"""A full history of changing entity attributes, built from periodic snapshots or updates.

Every observation is a unit interval. Neighbouring runs of one entity are merged pairwise, in a tree over the ordered
observation times: after log2(times) rounds each entity holds the list of its runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN_END = "9999-12-31"

_MERGED = """
case when l is null then r when r is null then l
     when element_at(l, -1).payload = r[0].payload
     then concat(l, slice(r, 2, size(r)))
     else concat(l, r) end"""


def attribute_history(df: DataFrame, entity: str, observed: str, loaded: str, attributes: dict[str, Column], open_end: str = OPEN_END) -> DataFrame:
    """One row per entity and longest run of consecutive observations with equal attributes.

    Columns: entity, valid_from (the run's first observation), valid_to (the first observation of the next run, or
    open_end), and the attributes. Defined cases: rows with a null entity or observation time are ignored; of several
    rows of one entity and time the one loaded last counts (null loaded counts as first, on a tie the larger
    attribute values); attribute nulls equal each other; an entity missing from a time neither ends nor splits a run;
    a value that returns starts a new run; an empty table gives an empty history. Rows of one entity are first reduced
    to one per time before any shuffle of the whole, so an entity holding most rows costs no more than its number
    of observation times; that number bounds the row in which its runs are held.
    """
    payload = F.struct(*[c.alias(n) for n, c in attributes.items()])
    last = (
        df.select(F.col(entity).alias("entity"), F.col(observed).alias("seen"), F.col(loaded).alias("loaded"), payload.alias("payload"))
        .filter("entity is not null and seen is not null")
        .groupBy("entity", "seen").agg(F.max(F.struct("loaded", "payload")).alias("m"))
        .select("entity", "seen", "m.payload")
    )
    times = df.select(F.col(observed).alias("seen")).filter("seen is not null").distinct()
    ordered = times.select("seen", (F.row_number().over(W.orderBy("seen")) - 1).alias("node"))
    n = times.count()
    runs = last.join(ordered, "seen").select("entity", "node", F.array(F.struct(F.col("seen").alias("start"), "payload")).alias("runs")).repartition("entity")
    for _ in range(max(0, n - 1).bit_length()):
        runs = (
            runs.groupBy("entity", F.expr("shiftright(node, 1)").alias("node"))
            .agg(F.first(F.expr("if(node % 2 = 0, runs, null)"), True).alias("l"), F.first(F.expr("if(node % 2 = 1, runs, null)"), True).alias("r"))
            .select("entity", "node", F.expr(_MERGED).alias("runs"))
        )
    each = runs.select("entity", "runs", F.posexplode("runs").alias("i", "run"))
    until = F.coalesce(F.get("runs", F.col("i") + 1)["start"], F.lit(open_end))
    return each.select(F.col("entity").alias(entity), F.col("run.start").alias("valid_from"), until.alias("valid_to"), *[F.col(f"run.payload.{a}").alias(a) for a in attributes])
