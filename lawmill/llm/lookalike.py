"""One consistent form for text that looks the same but differs in its characters.

The form is computed by DuckDB on the Arrow batches of each partition, with translate, regular expressions and
nfc_normalize in embedded SQL: width forms, radicals, look-alike letters and signs are mapped to one character,
characters that show nothing are removed, every kind of blank becomes a space, blanks at the ends are cut.
Compatibility forms that look different (circled digits, squared units, superscripts, other brackets) are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmill.functions.text import wide_hash
from lawmill.session import staged

# Letters of other scripts and blocks, each above the Latin letter it looks like.
_LETTERS = [
    ("АВЕКМНОРСТУХЅІЈԚԜӀҮаеорсухѕіјԛԝһԁӏёїЁЇ", "ABEKMHOPCTYXSIJQWIYaeopcyxsijqwhdlëïËÏ"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj"),  # Greek
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZRWSVSLCPKB"),  # Cherokee
    ("ՕՍՏօսոհզցյ", "OUSounhqgj"),  # Armenian
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ⲞⲢⲤⲦⲬⲘⲚⲎⲔⲈⲂⲀⲟⲥⲣ", "OPCTXMNHKEBAocp"),  # Coptic
    ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"),  # number forms of one letter
    ("ɑɡ", "ag"),
]
# Signs and Han look-alikes of other blocks, each above its usual sign.
_SIGNS = [
    ("‐‑−∕⁄∶∙⋅‧˗ꞏ", "---//:···-·"),
    ("○◯エカタトニハロ㇐㇑㇔㇚㇠", "〇〇工力夕卜二八口一丨丶亅乙"),
]
# Radicals of the supplement block that have no decomposition, each above the ideograph it looks like.
_RADICALS = (
    "⺁⺂⺃⺄⺅⺆⺉⺊⺋⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺬⺭⺮⺯⺰⺱⺲⺳⺶⺸⺹⺺⺻⺼⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乛乚乙亻冂刂卜㔾兀尣尢巳幺彑彐忄㣺扌攵旡月歺民氵氺灬爫爫丬牛犭王疋示礻竹糹纟罓罒㓁羊羋耂肀聿肉艹艹艹虎衤覀西见角讠贝足车辶辶辶阝钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
)
_BLANKS = "\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters that show nothing, as the body of a character class.
_INVISIBLE = (
    r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f\xad\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}"
    r"\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}"
    r"\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}"
)


#: Full-width marks that most texts hold, and the characters that no step but these marks' mapping would change.
_COMMON = ("，；：（）！？", ",;:()!?")
_PLAIN = r"[\x20-\x7e\x{3001}\x{3002}\x{3008}-\x{3011}\x{4e00}-\x{9fff}]*"


def width_map() -> dict[str, str]:
    """By rule: full-width and half-width forms to the usual width."""
    wide = ((chr(c), unicodedata.decomposition(chr(c)).split(" ")) for c in range(0xFF01, 0xFFEF))
    return {c: unicodedata.normalize("NFKC", c) for c, parts in wide if parts[0] in ("<wide>", "<narrow>")}


def look_map() -> dict[str, str]:
    """The fixed values above, and by rule the Kangxi radicals."""
    found = {a: b for pair in [*_LETTERS, *_SIGNS, _RADICALS] for a, b in zip(*pair, strict=True)}
    found |= dict.fromkeys(_BLANKS, " ") | dict.fromkeys("\u2028\u2029\u0085", "\n")
    radicals = (chr(c) for c in range(0x2E80, 0x2FD6))
    return found | {c: unicodedata.normalize("NFKC", c) for c in radicals if unicodedata.decomposition(c).startswith("<compat>")}


def _translate(x: str, table: dict[str, str]) -> str:
    quoted = ["'" + "".join(side).replace("'", "''") + "'" for side in (table, table.values())]
    return f"translate({x}, {', '.join(quoted)})"


def form_sql(column: str) -> str:
    """The consistent form of a text column, as DuckDB SQL; null stays null.

    DuckDB builds the maps of translate anew for each row, so texts of plain characters get by with the short one.
    """
    plain = f"translate({column}, '{_COMMON[0]}', '{_COMMON[1]}')"
    shown = f"regexp_replace({column}, '[{_INVISIBLE}]', '', 'g')"
    mapped = f"nfc_normalize({_translate(f'nfc_normalize({_translate(shown, width_map())})', look_map())})"
    ends = rf"regexp_replace({mapped}, '^[ \n\r]+|[ \n\r]+$', '', 'g')"
    return f"case when regexp_full_match({plain}, '{_PLAIN}') then trim({plain}, ' ') else {ends} end"


def consistent_form(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a further string column for each (source -> new name) of columns, holding the consistent form.

    Null stays null, empty stays empty, a text of nothing but blanks and invisible characters becomes empty; texts of
    any length are processed whole. Other columns pass through untouched, whatever their names; a new name must not
    be one of df's own (ValueError).
    """
    if clash := set(columns.values()) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in columns.values())])
    forms = ", ".join(f"{form_sql(f'c{i}')} as c{i}" for i in range(len(columns)))
    sources = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            texts = pa.table({f"c{i}": batch.column(s).cast(pa.string()) for i, s in enumerate(sources)} | {"i": pa.array(range(batch.num_rows), pa.int64())})
            con.register("texts", texts)
            done = con.sql(f"select {forms} from texts order by i").to_arrow_table()
            con.unregister("texts")
            new = [done.column(i).cast(pa.string()).combine_chunks() for i in range(len(sources))]
            new = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in new]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *columns.values()])

    return df.mapInArrow(run, schema)


def form_keys(fields: list[tuple[str, DataFrame, str, str, str | None]], label: str) -> DataFrame:
    """Compact keys of every non-null text: field, id, the 128-bit hash of (field, scope, form) and that of the text.

    fields: (name, table, id column, text column, scope column or None); equal forms count within one scope. A null
    scope is a scope of its own. The result is staged, as it is read more than once.
    """
    parts = [
        t.select(F.lit(n).alias("field"), F.col(i).cast("long").alias("id"), (F.col(s) if s else F.lit("")).alias("scope"), F.col(c).alias("raw")).filter("raw is not null")
        for n, t, i, c, s in fields
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    k1, k2 = wide_hash(F.col("field"), F.coalesce(F.concat(F.lit("="), F.col("scope")), F.lit("")), F.col("form"))
    r1, _ = wide_hash(F.col("raw"))
    return staged(consistent_form(rows, {"raw": "form"}).select("field", "id", k1.alias("k1"), k2.alias("k2"), r1.alias("r")), label)


def mixed(keys: DataFrame) -> DataFrame:
    """The keys of forms that are stored in more than one way, with the number of rows; combined before the shuffle."""
    seen = keys.groupBy("k1", "k2").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("rows"))
    return seen.filter("a <> b").select("k1", "k2", "rows")


def lookalike_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of rows (field, id_a < id_b) of equal form whose stored characters differ. A pair of rows is reported
    once, rows of equal characters are no pair; a row never pairs with itself. Forms stored in one way only are
    dropped before the join; a form held by very many rows is split by Spark's skew join."""
    some = keys.join(mixed(keys).select("k1", "k2"), ["k1", "k2"], "left_semi")
    a, b = some.alias("a"), some.alias("b")
    return (
        a.join(b, [F.col("a.k1") == F.col("b.k1"), F.col("a.k2") == F.col("b.k2"), F.col("a.id") < F.col("b.id"), F.col("a.r") != F.col("b.r")])
        .select(F.col("a.field").alias("field"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    )


def lookalike_classes(keys: DataFrame) -> DataFrame:
    """One row per row whose form is stored in more than one way: field, id, the class (smallest id) and its rows."""
    per = keys.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows"), F.min("r").alias("x"), F.max("r").alias("y"))
    return keys.join(per.filter("x <> y"), ["k1", "k2"]).select("field", "id", "class_id", "class_rows")
