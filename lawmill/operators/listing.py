"""Listings of a catalog and small relational steps around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions.titles import norm_title, short_title
from lawmill.operators.catalog import first_by
from lawmill.operators.contain import containing

# The display order of categories.
CATEGORY_ORDER = (
    "宪法", "宪法相关法", "民法商法", "行政法", "经济法", "社会法", "生态环境法", "刑法", "诉讼与非诉讼程序法", "法律解释", "有关法律问题的决定", "宪法修正案", "法律修改废止决定", "行政法规",
    "行政法规修改废止决定", "监察法规", "高法司法解释", "高检司法解释", "联合司法解释", "司法解释修改废止决定",
)
LAST = 99


def category_position(c: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in CATEGORY_ORDER]), c), F.lit(0)) - 1, F.lit(LAST)).cast("int")


def select_laws(df: DataFrame, layers: tuple[str, ...] = ("current",), law: str = "", category: str = "") -> DataFrame:
    """Laws of the layers (null counts as current) whose title holds the name, with or without the state's, and whose
    category holds the given words; laws without a text stay."""
    rows = df.filter(F.coalesce(F.trim("layer"), F.lit("current")).isin(*layers))
    if law:
        rows = rows.filter(F.contains(F.col("title"), F.lit(law)) | F.contains(F.col("title"), short_title(F.lit(law))))
    return rows.filter(F.contains(F.col("category"), F.lit(category))) if category else rows


def metadata_search(df: DataFrame, terms: list[str]) -> DataFrame:
    """Laws whose title, category and issuer together hold all terms; null is ''."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "category", "issuer")])
    for t in terms:
        df = df.filter(F.contains(text, F.lit(t)))
    return df


def clipped(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("…"))).otherwise(c)


def merged_parts(df: DataFrame, key: str, part: str, text: str, parts: list[str]) -> DataFrame:
    """key, text: the named parts joined in order under headings, for keys that have them all. Of a repeated part the
    smallest text counts; null texts count as missing."""
    picked = df.groupBy(key).agg(*[F.min(F.when(F.col(part) == p, F.col(text))).alias(f"_{i}") for i, p in enumerate(parts)])
    full = picked.filter(" and ".join(f"_{i} is not null" for i in range(len(parts))))
    return full.select(key, F.concat_ws("\n\n", *[F.concat(F.lit(f"## {p}\n\n"), F.col(f"_{i}")) for i, p in enumerate(parts)]).alias("text"))


def held_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, other of the pairs whose keys hold one another (either way). Empty and null keys hold nothing."""
    x, y = a.select("key"), b.select(F.col("key").alias("other"))
    one = containing(x.select(F.col("key").alias("o")), y.select(F.col("other").alias("i"))).select(F.col("o").alias("key"), F.col("i").alias("other"))
    two = containing(y.select(F.col("other").alias("o")), x.select(F.col("key").alias("i"))).select(F.col("i").alias("key"), F.col("o").alias("other"))
    return one.unionByName(two).distinct()


def supplement(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """key, path, how: the source of the same key, else the first (by path) whose key holds it or is held by it."""
    exact = first_by(sources.filter("key <> ''"), ["key"], F.asc("path"))
    keys = wanted.select("key").filter("key <> ''").distinct()
    near = held_in(keys.join(exact, "key", "left_anti"), exact).join(exact.select(F.col("key").alias("other"), "path"), "other")
    near = near.groupBy("key").agg(F.min("path").alias("path")).withColumn("how", F.lit("held"))
    return keys.join(exact.select("key", "path"), "key").withColumn("how", F.lit("exact")).unionByName(near.select("key", "path", "how"))


def fresh(df: DataFrame, at: str, now: Column, days: float) -> DataFrame:
    """Rows not older than so many days."""
    return df.filter(F.unix_micros(F.col(at)) >= F.unix_micros(now) - int(days * 86_400_000_000))


def rewrite_list(c: Column, most: int) -> Column:
    """The list in a model's answer: a JSON array of strings between the outermost brackets, else the parts between line ends
    and semicolons without numbering and quotes. Blank entries are dropped; null gives an empty list."""
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?m)^```(?:json)?|```$", ""))
    parsed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")
    listed = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    parts = F.filter(F.split(text, r"[\n；;]+"), lambda x: F.trim(x) != "")
    edge = r"[ \t\-\"'、,，0-9.）)]+"
    loose = F.transform(parts, lambda x: F.regexp_replace(x, f"^{edge}|{edge}$", ""))
    ok = parsed.isNotNull() & ~F.exists(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: x.isNull())
    return F.slice(F.when(ok, listed).otherwise(loose), 1, most)


# The codes of categories whose texts are fetched together; all others are the first group.
GROUPS = {"行政法规": (210, 215, 220), "司法解释": (320, 330, 340, 350), "地方法规": (230, 260, 270, 290, 295, 300, 305, 310)}
FIRST_GROUP = "法律语料"
AMENDED = "修正文本|修正案"


def group_of(code: Column) -> Column:
    """The group of a category code; null and unknown codes belong to the first."""
    out = F.lit(FIRST_GROUP)
    for name, codes in GROUPS.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def group_position(group: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in (FIRST_GROUP, *GROUPS)]), group).cast("int")


def checklist(rows: DataFrame, status_names: dict[int, str]) -> DataFrame:
    """What a catalog wants kept: title, category, promulgated, effective, status, issuer of its rows (the same, and
    status_code). Of constitutions only amended texts and amendments; null texts are ''; an unknown status says so."""
    kept = rows.filter((F.coalesce("category", F.lit("")) != "宪法") | F.col("title").rlike(AMENDED))
    named = F.concat(F.lit("未知("), F.coalesce(F.col("status_code").cast("string"), F.lit("None")), F.lit(")"))
    for code, name in status_names.items():
        named = F.when(F.col("status_code") == code, name).otherwise(named)
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    return kept.select("title", "category", text("promulgated"), text("effective"), named.alias("status"), text("issuer"))


def title_index(nodes: DataFrame, folders: list[str]) -> DataFrame:
    """title, date, year, path, size of the markdown files one level below the named folders of a source tree (path, type,
    size). The title is the file's name in normal form without its date (YYYY-MM-DD) at the end; names without a date may
    hold a year; names that start with an underscore are left out."""
    parts, stem = F.split("path", "/"), F.regexp_extract("path", r"^[^/]+/(.*)\.md$", 1)
    dated = r"\((\d{4}-\d{2}-\d{2})\)$"
    found = nodes.filter((F.col("type") == "blob") & F.endswith("path", F.lit(".md")) & (F.size(parts) == 2) & parts[0].isin(*folders) & ~F.startswith(parts[1], F.lit("_")))
    date = F.nullif(F.regexp_extract(stem, dated, 1), F.lit(""))
    year = F.when(date.isNull(), F.nullif(F.regexp_extract(stem, r"[（(](\d{4})年[)）]", 1), F.lit("")))
    return found.select(norm_title(F.trim(F.regexp_replace(stem, dated, ""))).alias("title"), date.alias("date"), year.alias("year"), "path", F.coalesce("size", F.lit(0)).alias("size"))


def stale_files(existing: DataFrame, kept: DataFrame) -> DataFrame:
    """Files (file) of folders below the root that a manifest no longer lists; files at the root are left alone."""
    return existing.select("file").filter(F.contains("file", F.lit("/"))).distinct().join(kept.select("file"), "file", "left_anti")
