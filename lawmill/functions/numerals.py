"""Han numerals, article labels and dates written in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawmill.functions.text import stripped

_DIGITS = "零一二三四五六七八九"
_FROM_HAN = ("〇○零一二两三四五六七八九", "0001223456789")
NUM = "0-9〇○零一二三四五六七八九十"
EFFECTIVE = rf"([{NUM}]{{2,4}})\s*年\s*([{NUM}]{{1,3}})\s*月\s*([{NUM}]{{1,3}})\s*日起施行"
FROM_PUBLICATION = "自(?:公布|发布)之日起施行"
ARTICLE = r"^第[零一二三四五六七八九十百千万两]+\s*条"


def to_han(n: Column) -> Column:
    """1..9999 in Han numerals (10-19 without the leading one); '' below 1, null above 9999 and for null."""
    text = F.lpad(n.cast("string"), 4, "0")
    digit = lambda i: F.substr(text, F.lit(i), F.lit(1))
    spoken = F.concat(*[F.when(digit(i) == "0", F.lit("零")).otherwise(F.concat(F.translate(digit(i), "123456789", _DIGITS[1:]), F.lit(u))) for i, u in ((1, "千"), (2, "百"), (3, "十"), (4, ""))])
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(spoken, "零+$", ""), "^零+", ""), "零+", "零")
    return F.when(n <= 0, "").when(n > 9999, F.lit(None)).otherwise(F.regexp_replace(plain, "^一十", "十"))


def article_label(raw: Column) -> Column:
    """88, 第八十八条, 八十八 or 八十八条 as 第八十八条."""
    s = stripped(F.coalesce(raw, F.lit("")))
    n = F.when(s.rlike(r"^\d{1,4}$"), s.cast("int"))
    return (
        F.when(n.isNotNull(), F.concat(F.lit("第"), to_han(n), F.lit("条")))
        .when(F.contains(s, F.lit("条")), F.when(F.startswith(s, F.lit("第")), s).otherwise(F.concat(F.lit("第"), s)))
        .otherwise(F.concat(F.lit("第"), s, F.lit("条")))
    )


def han_to_int(c: Column) -> Column:
    """1993, 一九九三 and 二十 as integers; null for anything else."""
    s = stripped(c)
    placed = F.translate(s, *_FROM_HAN)
    tens = r"^([一二两三四五六七八九]?)十([一二两三四五六七八九]?)$"
    part = lambda i, empty: F.coalesce(F.nullif(F.translate(F.regexp_extract(s, tens, i), *_FROM_HAN), F.lit("")).cast("int"), F.lit(empty))
    return F.when(placed.rlike(r"^\d{1,9}$"), placed.cast("int")).when(s.rlike(tens), part(1, 1) * 10 + part(2, 0))


def effective_in_text(text: Column, promulgated: Column) -> Column:
    """The last readable date from which a text says it is in force; the date of promulgation where the text only says
    'from its publication'; else ''."""
    found = F.regexp_extract_all(text, F.lit(EFFECTIVE), F.lit(0))
    days = F.transform(found, lambda m: F.struct(*[han_to_int(F.regexp_extract(m, EFFECTIVE, i)).alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"))]))
    good = F.filter(days, lambda x: (x["y"] > 0) & (x["m"] > 0) & (x["d"] > 0))
    last = F.try_element_at(good, F.lit(-1))
    iso = F.format_string("%04d-%02d-%02d", last["y"], last["m"], last["d"])
    given = F.coalesce(promulgated, F.lit(""))
    return F.when(F.size(good) > 0, iso).when((given != "") & text.rlike(FROM_PUBLICATION), given).otherwise(F.lit(""))


def snapshot_age(retrieved: Column, today: Column) -> Column:
    """Days since a snapshot; null if its day cannot be read."""
    return F.date_diff(today, F.try_to_date(retrieved, "yyyy-MM-dd"))
