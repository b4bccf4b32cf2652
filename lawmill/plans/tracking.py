"""Queries on what changed and what held when, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.functions.text import iso_date, plain_title, void_as_empty
from lawmill.operators.history import attribute_history
from lawmill.operators.snapshots import snapshot_changes
from lawmill.session import table


def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(
        table(spark, d, "check_updates"), "snapshot", plain_title(F.col("title")),
        {"promulgated": iso_date(F.col("promulgated")), "effective": iso_date(F.col("effective"))}, "received_at", "title",
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return catalog_changes(spark, d).select("snapshot", "title", "change")


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return catalog_changes(spark, d)


def law_history(spark: SparkSession, d: str) -> DataFrame:
    return attribute_history(
        table(spark, d, "build_from_downloads"), "file", "retrieved", "loaded_at",
        {"status": void_as_empty(F.col("status")), "layer": void_as_empty(F.col("layer")), "effective": iso_date(F.col("effective"))},
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return law_history(spark, d).select("file", "valid_from", "valid_to")


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    return law_history(spark, d)


def _sql_strip(c: str) -> str:
    return rf"coalesce(regexp_replace({c}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+$', '', 'g'), '')"


def _sql_day(c: str) -> str:
    s, p = _sql_strip(c), r"^(\d{4})(?:[-/.年](\d{1,2})[-/.月](\d{1,2})日?|(\d{2})(\d{2}))(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?$"
    part = lambda *g: "lpad(" + " || ".join(f"regexp_extract({s}, '{p}', {i})" for i in g) + ", 2, '0')"
    return f"case when regexp_matches({s}, '{p}') then regexp_extract({s}, '{p}', 1) || '-' || {part(2, 4)} || '-' || {part(3, 5)} else {s} end"


_CHANGES_SQL = rf"""
with clean as (
  select snapshot, regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', '', 'g') as title,
         {_sql_day('promulgated')} as promulgated, {_sql_day('effective')} as effective, received_at
  from check_updates where snapshot is not null),
last as (
  select * from (select *, row_number() over (partition by snapshot, title order by received_at desc nulls last, promulgated desc, effective desc) as rn
                 from clean where title <> '') where rn = 1),
snaps as (select snapshot, lag(snapshot) over (order by snapshot) as before from (select distinct snapshot from clean)),
now as (select s.snapshot, s.before, l.title, l.promulgated, l.effective from last l join snaps s on l.snapshot = s.snapshot where s.before is not null),
was as (select s.snapshot, s.before, l.title, l.promulgated, l.effective from last l join snaps s on l.snapshot = s.before)
select coalesce(now.snapshot, was.snapshot) as snapshot, coalesce(now.title, was.title) as title,
       case when was.title is null then 'added' when now.title is null then 'removed' else 'changed' end as change@MORE@
from now full outer join was on now.snapshot = was.snapshot and now.title = was.title
where was.title is null or now.title is null or now.promulgated <> was.promulgated or now.effective <> was.effective
"""

_HISTORY_SQL = f"""
with last as (
  select * from (
    select file, retrieved, {_sql_strip('status')} as status, {_sql_strip('layer')} as layer, {_sql_day('effective')} as effective,
           row_number() over (partition by file, retrieved order by loaded_at desc nulls last, {_sql_strip('status')} desc, {_sql_strip('layer')} desc, {_sql_day('effective')} desc) as rn
    from build_from_downloads where file is not null and retrieved is not null) where rn = 1),
marked as (
  select *, lag(status) over w is null or lag(status) over w <> status or lag(layer) over w <> layer or lag(effective) over w <> effective as starts
  from last window w as (partition by file order by retrieved))
select file, retrieved as valid_from, coalesce(lead(retrieved) over (partition by file order by retrieved), '9999-12-31') as valid_to@MORE@
from marked where starts
"""

QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p4_found": p4_found, "p4_versions": p4_versions}
SQL = {
    "p1_found": _CHANGES_SQL.replace("@MORE@", ""),
    "p1_values": _CHANGES_SQL.replace("@MORE@", ", was.promulgated as was_promulgated, now.promulgated as now_promulgated, was.effective as was_effective, now.effective as now_effective"),
    "p4_found": _HISTORY_SQL.replace("@MORE@", ""),
    "p4_versions": _HISTORY_SQL.replace("@MORE@", ", status, layer, effective"),
}
