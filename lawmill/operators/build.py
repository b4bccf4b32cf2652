"""A corpus from files and an official list: labels, heads, dates, paths and texts of every file, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions import titles
from lawmill.functions.numerals import effective_in_text
from lawmill.functions.structure import document_heads
from lawmill.operators.catalog import match_official, numbered_names
from lawmill.sources.files import docx_paragraphs, read_archives, render_markdown

# Categories and states of what the official list does not say.
BY_ISSUER = (("全国人民代表大会|常务委员会", "有关法律问题的决定"), ("最高人民法院", "高法司法解释"), ("最高人民检察院", "高检司法解释"))
NO_CATEGORY, NO_STATUS, VOID_STATUS = "未分类", "未标注（官方库未收录该件状态）", "已失效（官方标题标注失效）"
AMENDING, OTHER_DECISION = "修改/废止决定", "时效性未标注（官方库未单列，按决定层处理）"
NO_TEXT, NOT_CURRENT = "（未取得正文，请通过官方链接查阅。）", "⚠️ 本文件不是现行有效版本，仅供了解沿革或处理旧案；引用前务必核对现行文本。"


def category_label(official: Column, title: Column) -> Column:
    """The official category, else one by who the title names, else none."""
    out = F.lit(NO_CATEGORY)
    for names, category in reversed(BY_ISSUER):
        out = F.when(title.rlike(names), category).otherwise(out)
    return F.coalesce(F.nullif(official, F.lit("")), out)


def status_label(official: Column, layer: Column, title: Column, category: Column, voided: Column) -> Column:
    """The official status, unless the title says that the text is void; decisions are told apart by what they decide."""
    known = F.coalesce(official, F.lit("")) != ""
    amends = title.rlike(titles.DECISION) | F.endswith(category, F.lit("修改废止决定"))
    decision = F.when(amends, AMENDING).otherwise(OTHER_DECISION)
    return F.when(F.coalesce(voided, F.lit(False)), VOID_STATUS).when((layer == "decision") & known, decision).when(known, official).otherwise(NO_STATUS)


def corpus(files: DataFrame, official: DataFrame, root: str = "corpus/") -> DataFrame:
    """One row per file: the fields of a manifest and `text`, the whole as markdown.

    files: name (title_YYYYMMDD.ext), paras (array of paragraphs, null where no text is had), source; official: title, date,
    status_code, status, effective, category, issuer. A date of effect comes from the list, else from the text. Names that come
    again are numbered in the order of the files' names; null names are ignored.
    """
    name = titles.split_name(F.col("name"))
    day = F.regexp_replace(name["date"], r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    known = files.filter("name is not null").select("name", "paras", "source", name["title"].alias("title"), day.alias("date"), name["voided"].alias("voided"))
    rows = document_heads(match_official(known, official), "paras", "title")
    rows = rows.withColumn("category", category_label(F.col("official_category"), F.col("title")))
    rows = rows.withColumn("status", status_label(F.col("status"), F.col("layer"), F.col("title"), F.col("category"), F.col("voided")))
    whole = F.array_join(F.coalesce("paras", F.array().cast("array<string>")), "\n")
    given, promulgated = F.coalesce("effective", F.lit("")), F.coalesce("promulgated", F.lit(""))
    rows = rows.withColumn("told", F.when(given == "", effective_in_text(whole, promulgated)).otherwise(""))
    effective = F.when(given != "", given).otherwise(F.col("told"))
    source = F.when(given != "", "official").when(F.col("told") != "", "text").otherwise("unknown")
    rows = rows.withColumn("stem", titles.safe_stem(F.col("title"), F.col("date"), F.col("category"), root))
    rows = numbered_names(rows.withColumn("path", F.concat("category", F.lit("/"), "stem")), "path", "name")
    or_dash = lambda c: F.when(c == "", "—").otherwise(c)
    issuer, number, history = F.coalesce("official_issuer", F.lit("")), F.col("head.doc_number"), F.col("head.history")
    notes = F.array_compact(F.array(
        F.concat_ws("　", F.concat(F.lit("【"), "status", F.lit("】")), F.concat(F.lit("公布："), or_dash(promulgated)),
                    F.concat(F.lit("施行："), F.when(source == "text", F.concat(effective, F.lit("（正文推定）"))).otherwise(or_dash(effective))),
                    F.concat(F.lit("制定机关："), or_dash(issuer)), F.concat(F.lit("文号："), or_dash(number))),
        F.when(history != "", F.concat(F.lit("沿革："), history)), F.when(F.col("layer") != "current", NOT_CURRENT),
    ))
    body = F.when(F.size("head.body") > 0, F.col("head.body")).otherwise(F.array(F.lit(NO_TEXT)))
    fields = {"title": F.col("title"), "category": F.col("category"), "layer": F.col("layer"), "status": F.col("status"), "promulgated": promulgated, "effective": effective,
              "effective_source": source, "issuer": issuer, "doc_number": number, "source": F.col("source"), "record_date": F.col("date")}
    return rows.select(
        "name", "title", "category", "layer", "status", promulgated.alias("promulgated"), effective.alias("effective"), source.alias("effective_source"), issuer.alias("issuer"),
        F.concat(F.lit(root), "unique_name", F.lit(".md")).alias("file"), F.when(F.size(F.coalesce("paras", F.array().cast("array<string>"))) > 0, "full").otherwise("metadata-only").alias("text_status"),
        F.coalesce("source", F.lit("")).alias("source"), "head.article_count", F.aggregate("head.body", F.lit(0), lambda n, x: n + F.length(x)).alias("chars"),
        render_markdown(fields, F.col("title"), notes, body).alias("text"),
    )


def archived_files(spark, path: str) -> DataFrame:
    """name, paras, source of the office files in the archives under a path; a file that cannot be read has no paragraphs."""
    members = read_archives(spark, path).filter("error is null and ext = '.docx'")
    return members.select("name", docx_paragraphs("content").alias("paras"), F.lit("archive").alias("source"))


def envelope(records: DataFrame) -> DataFrame:
    """One row: count, by_layer and by_status of a manifest, as maps."""
    by = lambda c: records.groupBy(F.coalesce(c, F.lit("")).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"by_{c}"))
    return records.agg(F.count("*").alias("count")).crossJoin(by("layer")).crossJoin(by("status"))  # three single rows

