"""Column expressions on titles, issuers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawmill.functions.text import stripped, without_tags

STATE_PREFIX = "^中华人民共和国"
# The generic tails of titles and the ranks of categories, by authority.
GENERIC_TAIL = (
    "(?:暂行条例|暂行办法|暂行规定|实施细则|实施办法|管理办法|实施意见|若干规定"
    "|条例|办法|规定|细则|决定|通知|规则|解释|批复|答复|意见)+$"
)
CATEGORY_RANK = {
    "宪法": 0, "法律": 1, "法律解释": 2, "行政法规": 3, "司法解释": 4, "有关法律问题和重大问题的决定（部分）": 5,
    "修改、废止的决定": 6, "地方法规": 8, "法规性决定": 9,
}
OTHER_RANK = 7
# The parts of an issuer's name that are not its place.
ISSUER_TAIL = (
    "(?:人民代表大会|人民代表大会常务委员会|人大常务委员会|人大常委会|人民政府|"
    "办公厅|办公室|管理委员会|管理局|委员会|人民政府法制办)+$"
)
DECISION = "关于(?:修改|废止|修改和废止)|修改、废止的决定"
VOID = r"[（(](?:失效|已失效)[)）]\s*$"


def letters_only(c: Column) -> Column:
    """Han characters, Latin letters and digits of a title."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^一-鿿A-Za-z0-9]", "")


def core_phrase(c: Column) -> Column:
    """A title without its generic tails, taken off up to three times while at least four characters remain."""
    core = letters_only(c)
    for _ in range(3):
        shorter = F.regexp_replace(core, GENERIC_TAIL, "")
        core = F.when(F.length(shorter) >= 4, shorter).otherwise(core)
    return core


def title_score(title: Column, phrase: Column, core: Column) -> Column:
    """4 the whole phrase, 3 the core, 2.5 begins with the core, 2 holds the core, 1.5 holds the phrase, else 0."""
    name = letters_only(title)
    has_core, has_phrase = core != "", phrase != ""
    return (
        F.when(has_phrase & (name == phrase), 4.0).when(has_core & (name == core), 3.0).when(has_core & F.startswith(name, core), 2.5)
        .when(has_core & F.contains(name, core), 2.0).when(has_phrase & F.contains(name, phrase), 1.5).otherwise(0.0)
    )


def category_rank(c: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in CATEGORY_RANK.items() for x in kv])
    return F.coalesce(ranks[F.coalesce(c, F.lit(""))], F.lit(OTHER_RANK))


def clean_title(c: Column) -> Column:
    return stripped(without_tags(F.coalesce(c, F.lit(""))))


def short_title(c: Column) -> Column:
    """Without the name of the state at its head."""
    return stripped(F.regexp_replace(F.coalesce(c, F.lit("")), STATE_PREFIX, ""))


def norm_title(c: Column) -> Column:
    """Without markup, the state's name and anything in parentheses."""
    return stripped(F.regexp_replace(F.regexp_replace(clean_title(c), STATE_PREFIX, ""), "[（(][^（()）]*[)）]", ""))


def match_key(c: Column) -> Column:
    """A title without the separators that file names lose."""
    return F.regexp_replace(c, r"[\s　、·]+", "")


def issuer_region(c: Column) -> Column:
    """The place in an issuer's name."""
    text = stripped(F.coalesce(c, F.lit("")))
    for _ in range(3):
        text = stripped(F.regexp_replace(text, ISSUER_TAIL, ""))
    return text


def split_name(name: Column) -> dict[str, Column]:
    """title, date (YYYYMMDD or null) and whether marked void, from a file name title_YYYYMMDD.ext."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    dated = r"(?s)^(.*)_(\d{8})$"
    title = F.when(stem.rlike(dated), F.regexp_extract(stem, dated, 1)).otherwise(stem)
    title = F.regexp_replace(F.regexp_replace(title, r"\+", "、"), "、{2,}", "、")
    title = F.regexp_replace(title, r"^[、_\s　]+|[、_\s　]+$", "")
    return {
        "title": F.when(title.rlike(VOID), stripped(F.regexp_replace(title, VOID, ""))).otherwise(title),
        "date": F.nullif(F.regexp_extract(stem, dated, 2), F.lit("")),
        "voided": title.rlike(VOID),
    }


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|]', "_")


def safe_stem(title: Column, date: Column, category: Column, root: str = "corpus/", most: int = 255) -> Column:
    """A file stem whose path stays within `most` bytes of UTF-8: too long ones are cut at a character and end in a
    short checksum of the whole."""
    base = F.concat(safe_filename(title), F.lit("("), F.coalesce(F.nullif(date, F.lit("")), F.lit("无日期")), F.lit(")"))
    budget = F.lit(most - len(root.encode()) - 1 - 3) - F.octet_length(category)
    digest = F.substr(F.lpad(F.lower(F.hex(F.crc32(base.cast("binary")))), 8, "0"), F.lit(1), F.lit(6))
    keep = F.greatest(F.lit(6), budget - 7)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(base))), lambda n: F.octet_length(F.left(base, n)) <= keep)
    cut = F.left(base, F.coalesce(F.array_max(fits), F.lit(0)))
    short = F.concat(F.rtrim(cut, F.lit("_")), F.lit("-"), digest)
    return F.when((budget < 24) | (F.octet_length(base) <= budget), base).otherwise(short)


def yaml_value(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def download_name(url: Column, inner: Column) -> Column:
    """The file name inside a signed link: encoded twice in the disposition, else once in a parameter."""
    outer = F.regexp_extract(F.try_url_decode(url), 'filename="([^"]+)"', 1)
    given = F.regexp_extract(F.try_url_decode(inner), "[?&]fileName=([^&]+)", 1)
    return F.coalesce(stripped(F.try_url_decode(F.nullif(outer, F.lit("")))), stripped(F.try_url_decode(F.nullif(given, F.lit("")))))
