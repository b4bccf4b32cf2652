"""Lines of a document as addressable clauses, and clauses as paragraphs. No shuffle: each text is cut in its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions.text import BLANK, stripped

# What begins an article, a chapter or section, a book or part, an item, and a heading line.
NUMBER = "[零一二三四五六七八九十百千万两]"
ARTICLE = rf"^第{NUMBER}+[{BLANK}]*条"
CHAPTER = rf"^第{NUMBER}+[{BLANK}]*[章节]"
BOOK = rf"^第{NUMBER}+[{BLANK}]*(?:分编|[编篇])"
ITEM = "^[（(][一二三四五六七八九十]+[）)]"
HEADING = rf"^#{{2,3}}[{BLANK}]*(.+?)[{BLANK}]*$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
#: Paragraphs of a clause that reranking looks at.
MOST_SEGMENTS = 8


def body_lines(text: Column) -> tuple[Column, Column]:
    """The lines after a front matter between two lines of ---, and how many lines came before them."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    rules = F.filter(F.transform(lines, lambda x, i: F.when(stripped(x) == "---", i)), lambda i: i.isNotNull())
    offset = F.when((stripped(F.try_element_at(lines, F.lit(1))) == "---") & (F.size(rules) > 1), F.try_element_at(rules, F.lit(2)) + 1).otherwise(0)
    return F.slice(lines, offset + 1, F.size(lines)), offset


def first_word(line: Column) -> Column:
    return F.regexp_extract(line, rf"^[{BLANK}]*([^{BLANK}]+)", 1)


def clauses(df: DataFrame, text: str) -> DataFrame:
    """df with one row per clause of `text` and the columns article, chapter, body and line (numbered in the file).

    A clause begins at an article line and ends before the next article or heading; its label is the line's first
    word; its body joins the lines by blanks. A heading is a chapter, or a book that clears the chapter, or else takes
    the book's place; the path is book and chapter. Texts without article lines, empty and null texts give no rows.
    """
    lines, offset = body_lines(F.col(text))
    head = lambda x: F.regexp_extract(x, HEADING, 1)
    kind = lambda x: (
        F.when(x.rlike(HEADING), F.when(head(x).rlike(CHAPTER), "c").when(head(x).rlike(BOOK), "b").otherwise("o")).when(x.rlike(ARTICLE), "a")
    )
    names = [c for c in df.columns if c != text]
    # the three steps are materialized by generators, so that no expression is evaluated once per mark
    cut = df.select(*names, F.explode(F.array(lines)).alias("_lines"), offset.alias("_offset"))
    marks = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), kind(x).alias("k"), F.when(x.rlike(HEADING), head(x)).alias("label"))), lambda m: m["k"].isNotNull())
    marked = cut.select(*names, "_lines", "_offset", F.explode(F.array(marks)).alias("_marks"))
    marked = marked.select("*", F.explode(F.array(F.filter("_marks", lambda m: m["k"] != "a"))).alias("_heads"))

    def clause(m: Column, at: Column) -> Column:
        above = F.filter("_heads", lambda x: x["i"] < m["i"])  # headings only: far fewer than marks
        last = lambda *kinds: F.try_element_at(F.filter(above, lambda x: x["k"].isin(*kinds)), F.lit(-1))
        book = F.coalesce(last("b", "o")["label"], F.lit(""))
        chapter = F.when(last("c")["i"] > F.coalesce(last("b")["i"], F.lit(-1)), last("c")["label"]).otherwise("")
        end = F.coalesce(F.get("_marks", at + 1)["i"], F.size("_lines"))
        own = F.slice("_lines", m["i"] + 1, end - m["i"])
        return F.struct(
            first_word(F.get("_lines", m["i"])).alias("article"), F.array_join(F.filter(F.array(book, chapter), lambda x: x != ""), " ").alias("chapter"),
            F.array_join(F.filter(F.transform(own, stripped), lambda x: x != ""), " ").alias("body"), (m["i"] + F.col("_offset") + 1).cast("int").alias("line"),
        )

    # only the finished clauses are exploded: a row never carries the whole text
    found = F.filter(F.transform("_marks", lambda m, i: F.when(m["k"] == "a", clause(m, i))), lambda c: c.isNotNull())
    each = marked.select(*names, F.explode(found).alias("_c"))
    return each.select(*names, "_c.article", "_c.chapter", "_c.body", "_c.line")


def paragraphs(body: Column, head: Column, most: int | None = None) -> Column:
    """A clause's paragraphs with head and number in front, all or the first `most`; items join the paragraph before
    them; a single paragraph has no number. body: the clause's lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), LINE_END), stripped), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    # a mark between lines that stay apart, then one split: linear in the number of lines
    apart = F.array_join(F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike(ITEM), F.concat(F.lit(" "), x)).when(i > 0, F.concat(F.lit("\n"), x)).otherwise(x)), "")
    parts = F.filter(F.split(apart, "\n"), lambda x: x != "")
    numbered = F.transform(F.slice(parts, 1, most) if most else parts, lambda x, i: F.concat_ws(" ", head, F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("款")), x))
    return F.when(F.size(parts) > 1, numbered).when(F.size(parts) == 1, F.array(F.concat_ws(" ", head, parts[0]))).otherwise(F.array(head))


def hits_per_text(df: DataFrame, key: str, text: str, terms: list[str], any_term: bool = False, most: int = 3, width: int = 120) -> DataFrame:
    """key, line, text, label: the best lines of each text that holds all (or any) of the terms outside quoted lines.

    Lines are ranked by how many terms they hold, then by place, and come in order of place; the label is the nearest
    article or heading at or above the line. No terms, null or empty texts give no rows.
    """
    if not terms:
        return df.limit(0).select(F.col(key), F.lit(0).alias("line"), F.lit("").alias("text"), F.lit("").alias("label"))
    lines, offset = body_lines(F.col(text))
    holds = lambda s: [F.contains(s, F.lit(t)) for t in terms]
    number = lambda s: sum((h.cast("int") for h in holds(s)[1:]), holds(s)[0].cast("int"))
    shown = F.array_join(F.filter("_lines", lambda x: ~F.ltrim(x).startswith("> ")), "\n")
    found = number(shown)
    pre = df.filter((number(F.col(text)) > 0) if any_term else (number(F.col(text)) == len(terms)))  # before lines are cut
    cut = pre.select(F.col(key).alias("key"), F.explode(F.array(lines)).alias("_lines"), offset.alias("_offset"))
    cut = cut.filter(found > 0 if any_term else found == len(terms))
    scored = F.filter(F.transform("_lines", lambda x, i: F.struct((-number(x)).alias("n"), i.alias("i"))), lambda s: s["n"] < 0)
    best = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, most), lambda s: s["i"]))
    each = cut.select("key", "_lines", "_offset", F.explode(best).alias("i"))
    label = lambda x: F.when(x.rlike(ARTICLE), first_word(x)).when(F.startswith(x, F.lit("## ")), stripped(F.regexp_replace(x, "^[# ]+", "")))
    above = F.filter(F.transform(F.slice("_lines", 1, F.col("i") + 1), label), lambda x: x.isNotNull())
    line = stripped(F.get("_lines", F.col("i")))
    return each.select(
        F.col("key").alias(key), (F.col("i") + F.col("_offset") + 1).cast("int").alias("line"),
        F.when(F.length(line) > width, F.concat(F.left(line, F.lit(width)), F.lit("…"))).otherwise(line).alias("text"), F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit("")).alias("label"),
    )


def article_blocks(df: DataFrame, key: str, text: str, article: Column, terms: list[str] | None = None) -> DataFrame:
    """key, line, block: of each text the first line that begins with the article's label and what follows up to the next
    article, if the block holds all terms. Texts without the article give no row; null and empty texts neither."""
    lines, offset = body_lines(F.col(text))
    near = df.filter(F.contains(F.col(text), article))  # before lines are cut
    cut = near.select(F.col(key).alias("key"), article.alias("_article"), F.explode(F.array(lines)).alias("_lines"), offset.alias("_offset"))
    first = F.array_min(F.filter(F.transform("_lines", lambda x, i: F.when(F.startswith(x, F.col("_article")), i)), lambda i: i.isNotNull()))
    found = cut.select("key", "_lines", "_offset", F.explode(F.array(first)).alias("_at")).filter("_at is not null")
    rest = F.slice("_lines", F.col("_at") + 2, F.size("_lines"))
    ends = F.array_min(F.filter(F.transform(rest, lambda x, i: F.when(x.rlike(ARTICLE), i)), lambda i: i.isNotNull()))
    block = stripped(F.array_join(F.slice("_lines", F.col("_at") + 1, F.coalesce(ends, F.size(rest)) + 1), "\n"))
    out = found.select(F.col("key").alias(key), (F.col("_at") + F.col("_offset") + 1).cast("int").alias("line"), block.alias("block"))
    for t in terms or ():
        out = out.filter(F.contains("block", F.lit(t)))
    return out
