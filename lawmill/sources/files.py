"""Readers and writers for the file shapes of a document corpus: archives of office files, markdown, manifests, JSON lines."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmill.functions.text import stripped
from lawmill.functions.titles import yaml_value

MANIFEST = (
    "generated_by string, retrieved string, text_source string, count int, laws array<struct<title:string,category:string,layer:string,status:string,promulgated:string,"
    "effective:string,effective_source:string,issuer:string,official_url:string,file:string,text_status:string,source:string,article_count:int,chars:int>>"
)
LOCAL_RECORD = "bbbs string, title string, category string, region string, province string, issuer string, promulgated string, effective string, status string, status_code int, official_url string, text_status string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_INVISIBLE = re.compile("[\u200b\u200c\u200d\ufeff]")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per law of a manifest file, with the day of the snapshot."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return m.select("retrieved", F.explode("laws").alias("law")).select("retrieved", "law.*")


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a JSON file {key: [values]}: keys that start with an underscore are comments, values that are no lists
    and entries that are no texts are left out."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    return entries.filter("not startswith(key, '_') and startswith(raw, '[')").select("key", F.explode(F.from_json("raw", "array<string>")).alias("value")).filter("value is not null")


def expansion_map(expansions: DataFrame) -> dict[str, list[str]]:
    """Expansions (key, value) as the configuration that term building takes."""
    out: dict[str, list[str]] = {}
    for r in expansions.orderBy("key", "value").collect():
        out.setdefault(r.key, []).append(r.value)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole markdown files."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def front_matter(text: Column) -> Column:
    """The keys and unquoted values between the first two lines of ---, as a map; empty without them."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\w+:"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^\w+:\s*(.*?)\s*$", 1), r'^"(.*)"$', "$1").alias("v"))
    seen = F.transform(lines, entry)
    # of a repeated key the first value counts
    first = F.filter(seen, lambda e, i: ~F.exists(F.slice(seen, 1, i), lambda b: b["k"] == e["k"]))
    return F.map_from_entries(first)


def render_markdown(fields: dict[str, Column], title: Column, notes: Column, body: Column) -> Column:
    """A markdown file: front matter, title, quoted notes, and the body with ## before headings. notes and body are
    arrays of lines; null notes and empty fields are left out of nothing: every field is written."""
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), yaml_value(v)) for k, v in fields.items()], F.lit("---"))
    heading = "^第[零一二三四五六七八九十百千万两]+\\s*(?:分编|[编章节篇])"
    lines = F.transform(body, lambda x: F.when(x.rlike(heading), F.concat(F.lit("## "), x)).otherwise(x))
    return F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("# "), title), F.array_join(F.transform(notes, lambda x: F.concat(F.lit("> "), x)), "\n"), F.array_join(lines, "\n"))


# Fixed value: what parts a source text's notes from its body.
INFO_MARK = "<!-- INFO END -->"


def split_info_block(text: Column) -> tuple[Column, Column]:
    """The notes before the mark and the body after it, both without blanks at the ends; without a mark all is body."""
    has, at = F.contains(text, F.lit(INFO_MARK)), F.position(F.lit(INFO_MARK), text)
    notes = F.when(has, stripped(F.substr(text, F.lit(1), at - 1))).otherwise("")
    return notes, stripped(F.when(has, F.substr(text, at + len(INFO_MARK))).otherwise(text))


def without_heading(text: Column) -> Column:
    """A text without a first line that is a heading of the first level."""
    return stripped(F.regexp_replace(text, r"\A# [^\n]*(?:\n|\z)", ""))


def _archive_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            name = info.filename.rsplit("/", 1)[-1]
                            rows.append((path, name, "." + name.rsplit(".", 1)[-1].lower() if "." in name else "", z.read(info), None))
            except (zipfile.BadZipFile, zlib.error, EOFError) as e:
                rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=["archive", "name", "ext", "content", "error"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, ext (lower case), content of every file in the zip archives; a broken archive gives the files before the
    break and a row with nothing but its name and the error."""
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return zips.mapInPandas(_archive_members, "archive string, name string, ext string, content binary, error string")


def paragraphs_of(content: bytes | None) -> list[str] | None:
    """The paragraphs of a docx file in order, line breaks inside one parting it; null for a file that is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(e.text or "" if e.tag == f"{_W}t" else "\n" if e.tag == f"{_W}br" else "\t" if e.tag == f"{_W}tab" else "" for e in p.iter())
        out += [s for s in (x.replace("\u3000", " ").strip() for x in _INVISIBLE.sub("", text).split("\n")) if s]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def docx_paragraphs(content: pd.Series) -> pd.Series:
    return content.map(paragraphs_of)


def write_vectors(df: DataFrame, path: str) -> None:
    """key, vec as parquet; vectors are scaled to unit length, a zero vector stays."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = F.transform("vec", lambda x: (x / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).cast("float"))
    df.withColumn("_n", norm).select("key", unit.alias("vec")).write.mode("overwrite").parquet(path)


def pending(keys: DataFrame, state: DataFrame, on: list[str]) -> DataFrame:
    """What a checkpointed run still has to do: keys (with their content hash) that the state does not hold."""
    return keys.join(state, on, "left_anti")
