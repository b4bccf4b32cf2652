"""Catalogs of documents: matching files with official lists, layers, newest versions, choice of sources, title search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.functions.titles import DECISION, category_rank, core_phrase, letters_only, match_key, title_score
from lawmill.operators.contain import containing

# Official status codes, their names and layers.
STATUS_NAME = {1: "已废止", 2: "已修改", 3: "现行有效", 4: "尚未生效", -1: "已失效"}
STATUS_LAYER = {1: "historical", 2: "historical", 3: "current", 4: "current", -1: "historical"}
MERGED, SUPERSEDED = "现行有效（合并文本，含官方清单未单列的后续修正）", "已修改（官方清单已有更新版本）"


def _lookup(code: Column, table: dict[int, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def layer_of(matched: Column, code: Column, title: Column, voided: Column) -> Column:
    """Void files are historical, decisions are decisions; then unmatched files stay current, a missing code makes a
    decision, any other the layer of its status."""
    base = F.when(~matched, "current").when(code.isNull(), "decision").otherwise(_lookup(code, STATUS_LAYER, "unknown"))
    return F.when(F.coalesce(voided, F.lit(False)), "historical").when(title.rlike(DECISION), "decision").otherwise(base)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest_per_title(df: DataFrame, title: str, date: str, *tiebreak: str) -> DataFrame:
    """The row of the latest date for each title; rows without title are ignored, null dates come last."""
    return first_by(df.filter(F.col(title).isNotNull()), [title], F.desc_nulls_last(date), *tiebreak)


def match_official(files: DataFrame, official: DataFrame) -> DataFrame:
    """files (file, title, date, voided) with status_code, status, promulgated, effective, how and layer from the list.

    official: title, date, status_code, status, effective; dates are YYYY-MM-DD. A file matches the entry of its title
    and date; else it takes the newest entry of its title, or of its title without separators: a later file is a merged
    text still in force, an earlier one a superseded version. how: exact, title, key or none. Repeated entries count
    once (the largest status code, then status); null titles match nothing. Where the list has category and issuer, they come
    along as official_category and official_issuer.
    """
    more = [c for c in ("category", "issuer") if c in official.columns]
    entries = first_by(official.filter("title is not null"), ["title", "date"], F.desc_nulls_last("status_code"), F.desc_nulls_last("status"), F.desc_nulls_last("effective"))
    cols = lambda p: [F.col("date").alias(f"{p}_date"), F.col("status_code").alias(f"{p}_code"), F.col("status").alias(f"{p}_status"), F.col("effective").alias(f"{p}_eff"), F.lit(True).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in more]]
    exact = entries.filter("date is not null").select(F.col("title").alias("_t"), F.col("date").alias("_d"), *cols("e"))
    by_title = newest_per_title(entries, "title", "date").select(F.col("title").alias("_t1"), *cols("t"))
    keyed = entries.withColumn("key", match_key(F.col("title"))).filter("key <> ''")
    by_key = first_by(keyed, ["key"], F.desc_nulls_last("date"), F.col("title")).select(F.col("key").alias("_k"), *cols("n"))
    f = files.join(exact, (files["title"] == F.col("_t")) & (files["date"] == F.col("_d")), "left").join(by_title, files["title"] == F.col("_t1"), "left")
    f = f.withColumn("_key", match_key(F.col("title"))).join(by_key, F.col("_key") == F.col("_k"), "left")
    how = F.when(F.col("e"), "exact").when(F.col("t"), "title").when(F.col("n"), "key").otherwise("none")
    pick = lambda c: F.when(F.col("e"), F.col(f"e_{c}")).when(F.col("t"), F.col(f"t_{c}")).otherwise(F.col(f"n_{c}"))
    f = f.select(*[F.col(c) for c in files.columns], how.alias("how"), pick("date").alias("_od"), pick("code").alias("_oc"), pick("status").alias("_os"), pick("eff").alias("_oe"), *[pick(c).alias(f"official_{c}") for c in more])
    later = ~F.col("how").isin("exact", "none") & (F.col("date") > F.col("_od"))
    earlier = ~F.col("how").isin("exact", "none") & (F.col("date") < F.col("_od"))
    code = F.when(later, 3).when(earlier, 2).otherwise(F.col("_oc"))
    return f.select(
        *files.columns, "how", code.alias("status_code"), F.when(later, MERGED).when(earlier, SUPERSEDED).otherwise(F.col("_os")).alias("status"),
        F.when(later | earlier, F.col("date")).otherwise(F.col("_od")).alias("promulgated"), F.when(later | earlier, "").otherwise(F.col("_oe")).alias("effective"),
        layer_of(F.col("how") != "none", code, F.col("title"), F.col("voided")).alias("layer"), *[f"official_{c}" for c in more],
    )


def catalog_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """title, change: added (remote only), gone (local only) or changed (promulgated or effective differ; null and ''
    are the same). local, remote: title (unique), promulgated, effective."""
    a = local.select("title", F.struct(F.coalesce("promulgated", F.lit("")), F.coalesce("effective", F.lit(""))).alias("a"))
    b = remote.select("title", F.struct(F.coalesce("promulgated", F.lit("")), F.coalesce("effective", F.lit(""))).alias("b"))
    both = a.join(b, "title", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("title", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").otherwise("changed").alias("change"))


def pick_source(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """wanted (key, title, promulgated) with the source (date, path) that serves it best: the same date, else the same
    year, else the latest dated, else the first by path."""
    rows = wanted.select("key", "title", "promulgated").join(sources.select("title", "date", F.substring("date", 1, 4).alias("year"), "path"), "title")
    tier = F.when(F.col("date") == F.col("promulgated"), 0).when(F.col("year") == F.substring("promulgated", 1, 4), 1).when(F.col("date").isNotNull(), 2).otherwise(3)
    return first_by(rows.withColumn("tier", tier), ["key"], F.asc("tier"), F.when(F.col("tier") == 2, F.col("date")).desc_nulls_last(), F.asc("path")).select("key", "title", "promulgated", "date", "path", "tier")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """All keys of both, new rows winning over existing ones; within a side the first in order wins."""
    both = existing.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    return first_by(both, keys, F.asc("_old"), *order).drop("_old")


def numbered_names(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `unique_name`: the second and later rows of a name get -2, -3, ... in the given order."""
    n = F.row_number().over(W.partitionBy(name).orderBy(*order))
    return df.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def title_search(queries: DataFrame, catalog: DataFrame, depth: int = 10) -> DataFrame:
    """qid, rank, title, promulgated, score: catalog entries whose title fits the query, best first.

    queries: qid, query; catalog: title, promulgated, category. Scores are those of title_score, order is score,
    category rank, length of the title, promulgated down, title. Only titles that hold the phrase or the core score; they are
    found by its rarest piece. Repeated entries of title and promulgated count once.
    """
    entries = first_by(catalog.filter("title is not null"), ["title", "promulgated"], category_rank(F.col("category"))).withColumn("name", letters_only(F.col("title")))
    q = queries.select("qid", letters_only(F.col("query")).alias("phrase"), core_phrase(F.col("query")).alias("core"))
    asked = q.withColumn("i", F.explode(F.array_distinct(F.array("phrase", "core")))).filter("i <> ''")
    pairs = containing(entries.select(F.col("name").alias("o")), asked.select("i"))
    score = title_score(F.col("title"), F.col("phrase"), F.col("core"))
    hits = pairs.join(asked, "i").join(entries, F.col("o") == F.col("name")).withColumn("score", score).filter("score > 0").dropDuplicates(["qid", "title", "promulgated"])
    w = W.partitionBy("qid").orderBy(F.desc("score"), category_rank(F.col("category")), F.length("name"), F.desc(F.coalesce("promulgated", F.lit(""))), "title")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth).select("qid", "rank", "title", "promulgated", "score")


def expansion_use(expansions: dict[str, list[str]], texts: DataFrame, file: str, text: str) -> DataFrame:
    """key, value, files: in how many files each expansion value occurs; 0 marks a miss. Expansions are configuration."""
    spark = texts.sparkSession
    pairs = [(k, v) for k, vs in expansions.items() if not k.startswith("_") and isinstance(vs, list) for v in vs]
    table = spark.createDataFrame(pairs, "key string, value string")
    if not pairs:
        return table.withColumn("files", F.lit(0).cast("long"))
    values = F.array(*[F.lit(v) for v in sorted({v for _, v in pairs})])
    seen = texts.select(F.col(file).alias("file"), F.explode(F.filter(values, lambda v: F.contains(F.col(text), v))).alias("value")).distinct()
    return table.join(seen.groupBy("value").agg(F.count("*").alias("files")), "value", "left").select("key", "value", F.coalesce("files", F.lit(0)).alias("files"))
