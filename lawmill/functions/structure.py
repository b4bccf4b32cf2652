"""A document's paragraphs as title, history, document number and body, without its table of contents.

Every paragraph gets two letters: what it could be in a head, and what it could be in a body. The letters of a document
make two short words, and where head, history, contents and body begin and end are matches of patterns in these words.
All of it is column expressions, so nothing leaves the JVM and a document is one row throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions.text import BLANK, stripped, without_blanks

# The words and forms by which lines of a head are known.
TITLE_ENDS = (
    "法 条例 规则 规定 办法 解释 决议 决定 细则 准则 标准 章程 纲要 计划 方案 通知 答复 批复 意见 报告 名单 目录 文本 修正案 法典 基本法"
).split()
COURTS = ("最高人民法院", "最高人民检察院")
BODIES = (*COURTS, "国务院", "主席")
DECREES = ("国务院令", "主席令")
SERIES = ("法释", "高检发释字")
PREFACES = ("序言", "前言", "引言")
HAN = "零一二三四五六七八九十百千万两"
STATE = "中华人民共和国"
#: A contents entry without number has at most so many characters; the contents begin within so many paragraphs; a head has at
#: most so many beyond the title; a title spans at most so many; so many headings in a row are contents without a heading.
SHORT_ENTRY, CONTENTS_WITHIN, HEAD_LINES, TITLE_LINES, BARE_CONTENTS = 25, 40, 19, 6, 5

_S = f"[{BLANK}]"
_any = lambda words: "(?:" + "|".join(words) + ")"
ARTICLE = rf"^第[{HAN}]+{_S}*条"
HEADING = rf"^第[{HAN}]+{_S}*(?:分编|[编章节篇])"
CONTENTS = rf"^目{_S}*录$"
TITLED = _any(TITLE_ENDS) + "[)）]?$"
CLOSED = rf"[)）]{_S}*$"
_SERIAL = _any(SERIES) + r"〔\d{4}〕\d+号"
_DECREE = STATE + _any(DECREES)
NUMBER = rf"^(?:{_SERIAL}|{_DECREE}第{_S}*[一二三四五六七八九十百\d]+{_S}*号)$"
NUMBER_INSIDE = rf"{_DECREE}第{_S}*\d+{_S}*号"
# a dated note, or one that tells of a passing; a list mark such as (一) is none
NOTE = rf"^(?:[（(]{_S}*(?:\d{{4}}|[〇○零一二三四五六七八九两]{{2,4}}){_S}*年|（.*?(?:通过|修正|修订|发布).*?）$)"
LIST_MARK = "^[（(][^）)]{0,3}[）)]"
MASTHEAD = [
    rf"^公{_S}*[告吿]$", "^" + STATE + _any(BODIES) + "$", "^" + _any(COURTS) + "$", r"^\d{4}年\d{1,2}月\d{1,2}日$", r"^第[一二三四五六七八九十百\d]+号$", f"^{_SERIAL}$", "^《[^》]*》已[于由经在]",
]

# In a word of head letters: t a title line, b a note, n a number, m a masthead, x anything else; upper case where it ends in a bracket.
NOTES = "(?:B|b[a-z]*(?:[A-Z]|$))"
HEAD = f"(?:[tTnNmM]|{NOTES})*"
# In a word of body letters: c contents, h heading, a article, f preface, s short, p anything else.
ENTRIES, BARE_ENTRIES = "^(?:f*[hsc])*", "^(?:f*h)*"


def head_letter(p: Column, before: Column, whole: Column) -> Column:
    title = p.rlike(TITLED) & ~F.coalesce(before.rlike(TITLED), F.lit(False))
    masthead = p.rlike("|".join(MASTHEAD)) | ((whole != "") & (without_blanks(p) == whole))
    letter = F.when(title, "t").when(p.rlike(NOTE) & ~p.rlike(LIST_MARK), "b").when(p.rlike(NUMBER), "n").when(masthead, "m").otherwise("x")
    return F.when(p.rlike(CLOSED), F.upper(letter)).otherwise(letter)


def body_letter(p: Column) -> Column:
    return (
        F.when(p.rlike(CONTENTS), "c").when(p.rlike(HEADING), "h").when(p.rlike(ARTICLE), "a").when(without_blanks(p).isin(*PREFACES), "f")
        .when((p != "") & (F.length(p) <= SHORT_ENTRY), "s").otherwise("p")
    )


def document_heads(df: DataFrame, paras: str, title: str) -> DataFrame:
    """df with a struct column `head`: title, history, doc_number, body, article_count, chapter_count.

    paras: array of paragraphs, title: the name the document goes by. Further paragraphs that continue the first as
    the title says belong to the title. Without contents the head ends at the first paragraph that is none of its kinds; with
    contents everything before them is head, and the body begins where the entries end, where the first entry comes
    again, or at the first article, whichever is first. Null and empty arrays give empty values; null paragraphs count as
    ''. Other columns pass through; a column `head` in df is an error.
    """
    if "head" in df.columns:
        raise ValueError("a column head is there already")
    names = [F.col(f"`{c}`") for c in df.columns]
    each = lambda c: F.explode(F.array(c))  # noqa: E731  a generator makes a value once; projections would repeat it
    start = lambda word, pattern, at: F.coalesce(F.nullif(F.regexp_instr(F.substr(word, at + 1), F.lit(pattern)), F.lit(0)) + at - 1, F.lit(10**9))

    p0 = F.transform(F.coalesce(F.col(paras), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    one = df.select(*names, F.struct(p0.alias("p"), without_blanks(F.coalesce(F.col(title), F.lit(""))).alias("whole")).alias("_a"))
    one = one.select(*names, each(F.struct("_a.p", "_a.whole", F.transform("_a.p", without_blanks).alias("tight"))).alias("_a"))
    p, whole, tight = F.col("_a.p"), F.col("_a.whole"), F.col("_a.tight")
    # the title: as many paragraphs as, put together, the whole name begins with
    together = lambda n: F.array_join(F.slice(tight, 1, n), "")
    begins = F.filter(F.sequence(F.lit(2), F.lit(TITLE_LINES)), lambda n: (n <= F.size(p)) & (F.element_at(tight, F.least(n, F.size(p))) != "") & F.startswith(whole, together(n)))
    # each further paragraph must add to it, so the longest beginning counts only up to the first that adds nothing
    lines = F.when(F.size(p) > 0, F.greatest(F.lit(1), F.coalesce(F.array_max(F.filter(begins, lambda n: F.size(F.filter(begins, lambda m: m < n)) == n - 2)), F.lit(1)))).otherwise(0)
    word = lambda letters: F.array_join(letters, "")
    heads = word(F.transform(F.slice(p, 1, CONTENTS_WITHIN), lambda x, i: head_letter(x, F.get(p, i - 1), whole)))
    two = one.select(*names, "_a", each(F.struct(lines.alias("at"), heads.alias("head"), word(F.transform(p, body_letter)).alias("body"))).alias("_b"))
    at, head, body = F.col("_b.at"), F.col("_b.head"), F.col("_b.body")
    contents = start(F.left(body, F.lit(CONTENTS_WITHIN)), "c", at)
    marked = contents < 10**9
    plain = F.substr(F.left(head, at + HEAD_LINES), at + 1)
    zone = F.when(marked, F.substr(F.left(head, contents), at + 1)).otherwise(F.regexp_extract(plain, f"^{HEAD}", 0))
    three = two.select(*names, "_a", "_b", each(F.struct(zone.alias("zone"), F.when(marked, contents).otherwise(at + F.length(zone)).alias("from"), marked.alias("marked"))).alias("_c"))
    zone, origin, marked = F.col("_c.zone"), F.col("_c.from"), F.col("_c.marked")
    note, note_at = F.regexp_extract(zone, NOTES, 0), F.regexp_instr(zone, F.lit(NOTES))
    history = F.when(note_at > 0, F.array_join(F.filter(F.transform(F.slice(p, at + note_at, F.length(note)), stripped), lambda x: x != ""), " ")).otherwise("")
    letter = lambda i: F.when((i + 1 > note_at) & (i + 1 < note_at + F.length(note)) & (note_at > 0), "").otherwise(F.lower(F.substr(zone, i + 1, F.lit(1))))
    own = F.transform(F.slice(p, at + 1, F.length(zone)), lambda x, i: F.when(letter(i) == "n", stripped(x)).when(letter(i) == "b", F.nullif(F.regexp_extract(x, NUMBER_INSIDE, 0), F.lit(""))))
    number = F.coalesce(F.get(F.array_compact(own), F.lit(0)), F.lit(""))
    first = origin + F.when(marked, 1).otherwise(0)
    rest = F.substr(body, first + 1)
    run = F.length(F.when(marked, F.regexp_extract(rest, ENTRIES, 0)).when(rest.rlike(f"^h{{{BARE_CONTENTS}}}"), F.regexp_extract(rest, BARE_ENTRIES, 0)).otherwise(""))
    four = three.select(*names, "_a", "_b", "_c", each(F.struct(history.alias("history"), number.alias("number"), first.alias("first"), run.alias("run"))).alias("_d"))
    first, run = F.col("_d.first"), F.col("_d.run")
    entry = start(F.left(body, first + run), "h", first)  # the first heading among the entries
    again = F.array_position(F.slice(tight, entry + 2, F.size(tight)), F.get(tight, entry))
    again = F.when((entry < 10**9) & (again > 0), entry + again.cast("int"))
    contents_end = F.least(first + run, F.coalesce(again, F.lit(10**9)), start(body, "a", first))
    begin = F.greatest(F.lit(1), F.when(marked | (run > 0), contents_end).otherwise(origin))
    five = four.select(*names, "_a", "_b", "_d", each(begin).alias("_e"))
    left = F.substr(body, F.col("_e") + 1)
    count = lambda letter: F.length(F.regexp_replace(left, f"[^{letter}]", ""))
    return five.select(*names, F.struct(
        F.coalesce(F.get(p, F.lit(0)), F.lit("")).alias("title"), F.col("_d.history").alias("history"), F.col("_d.number").alias("doc_number"),
        F.slice(p, F.col("_e") + 1, F.size(p)).alias("body"), count("a").alias("article_count"), count("h").alias("chapter_count"),
    ).alias("head"))
