"""A vector index on storage: vectors of unit length beside a row of meta data, and indexes kept as one archive of arrays."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.sources.files import write_vectors

META = "model string, dim int, count long, partial boolean, corpus_hash string, metadata_hash string"


def write_index(df: DataFrame, path: str, model: str, dim: int, partial: bool = False, corpus_hash: str = "", metadata_hash: str = "") -> None:
    """key, vec under path/vectors, scaled to unit length (a zero vector stays); meta data as one JSON row under path/meta."""
    write_vectors(df, f"{path}/vectors")
    spark = df.sparkSession
    meta = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("count"))
    named = {"model": model, "dim": dim, "partial": partial, "corpus_hash": corpus_hash, "metadata_hash": metadata_hash}
    meta.select("count", *[F.lit(v).alias(k) for k, v in named.items()]).write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, dict]:
    """The vectors (key, vec) and the meta data of an index; one of another dimension than the queries' is an error."""
    meta = spark.read.schema(META).json(f"{path}/meta").first().asDict()
    if meta["dim"] != dim:
        raise ValueError(f"the index has {meta['dim']} dimensions, the queries {dim}: build it anew with one model")
    return spark.read.schema("key string, vec array<float>").parquet(f"{path}/vectors"), meta


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for content in pdf["content"]:
            data = np.load(io.BytesIO(content), allow_pickle=False)
            keys, x = data["keys"], data["vectors"].astype(np.float32)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1)
            for lo in range(0, len(keys), 4096):
                yield pd.DataFrame({"key": [str(k) for k in keys[lo : lo + 4096]], "vec": list(x[lo : lo + 4096])})


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """key, vec (unit length) of archives that hold an array `keys` and a matrix `vectors` of any float width."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_arrays, "key string, vec array<float>")


def meta_of(text: str) -> dict:
    """Meta data of an index kept as one JSON text; what is missing is None."""
    return {k.split(" ")[0]: None for k in META.split(", ")} | json.loads(text)
