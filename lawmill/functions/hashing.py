"""Content hashes of clauses, equal to SHA-256 over canonical JSON of normalized values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, CRLF as LF, white space at the ends cut; null as ''. Spark has no such function of its own."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x or "").replace("\r\n", "\n").strip())


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def clause_json(law: Column, article: Column, body: Column, status: Column, layer: Column, file: Column) -> Column:
    """Keys in alphabetical order, no blanks, characters unescaped."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.to_json(F.struct(text(article).alias("article"), text(body).alias("body"), text(file).alias("file"), text(law).alias("law"), text(layer).alias("layer"), text(status).alias("status")))
