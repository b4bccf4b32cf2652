"""Views of the tables that several queries share, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.session import staged, table

#: Everyday words and what clauses say instead; an example of the configuration that term building takes.
EXPANSIONS = {
    "_note": ["keys that start with an underscore are comments"],
    "弄坏": ["毁损", "恢复原状"], "转手卖掉": ["处分", "追夺"], "欠我": ["余额", "计息"], "合租": ["共同保管"], "报警": ["应急管理"],
}
CURRENT = ("current",)


def clauses(spark: SparkSession, d: str, layers: tuple[str, ...] | None = CURRENT) -> DataFrame:
    """One row per clause (file and line): of repeated or late rows the one loaded last, then of the larger row_id."""
    t = table(spark, d, "audit_state").filter("file is not null and line is not null")
    kept = ["title", "category", "article", "chapter", "body", "status", "layer"]
    last = t.groupBy("file", "line").agg(F.max_by(F.struct(*kept), F.struct("loaded_at", "row_id")).alias("m")).select("file", "line", "m.*")
    last = last.withColumn("key", F.concat_ws("#", "file", "line"))
    return last if layers is None else last.filter(F.coalesce("layer", F.lit("current")).isin(*layers))


def searched(spark: SparkSession, d: str) -> DataFrame:
    """Current clauses, staged: ranking reads them several times."""
    return staged(clauses(spark, d).select("key", "title", "article", "body"), "clauses")


CLAUSES_SQL = """
all_clauses as (
  select file, line, title, category, article, chapter, body, status, layer, file || '#' || line as key
  from (select *, row_number() over (partition by file, line order by loaded_at desc nulls last, row_id desc) as rn
        from audit_state where file is not null and line is not null) where rn = 1),
clauses as (select * from all_clauses where coalesce(layer, 'current') = 'current')"""


def latest_laws(spark: SparkSession, d: str) -> DataFrame:
    """The last manifest row of each file."""
    t = table(spark, d, "build_from_downloads").filter("file is not null")
    kept = [c for c in t.columns if c not in ("file",)]
    return t.groupBy("file").agg(F.max_by(F.struct(*kept), F.struct("retrieved", "loaded_at", "row_id")).alias("m")).select("file", "m.*")


LAWS_SQL = """
laws as (select * from (select *, row_number() over (partition by file order by retrieved desc nulls last, loaded_at desc nulls last, row_id desc) as rn
                        from build_from_downloads where file is not null) where rn = 1)"""
