"""Vectors from a pluggable embedder, in batches, for what an index does not hold yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmill.session import spread
from lawmill.sources.files import pending

Embedder = Callable[[list[str]], "np.ndarray"]


def embedded(df: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """key, hash, vec of df (key, hash, text). The embedder is called in the workers with lists of at most `batch` texts;
    null texts are embedded as ''. A result of the wrong length is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            vectors = [v for lo in range(0, len(texts), batch) for v in np.asarray(embedder(texts[lo : lo + batch]), dtype=np.float32)]
            if len(vectors) != len(texts):
                raise ValueError("the embedder returned another number of vectors")
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hash"), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], names=["key", "hash", "vec"])

    return spread(df.select("key", "hash", "text")).mapInArrow(run, "key string, hash string, vec array<float>")


def resumed(clauses: DataFrame, index: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """The index (key, hash, vec) brought up to date with clauses (key, hash, text): vectors of unchanged clauses are kept,
    those of changed and new ones computed, those of vanished ones dropped."""
    kept = index.join(clauses.select("key", "hash"), ["key", "hash"], "left_semi").select("key", "hash", "vec")
    return kept.unionByName(embedded(pending(clauses, index.select("key", "hash"), ["key", "hash"]), embedder, batch))


def embedding_text(df: DataFrame) -> DataFrame:
    """key, text of clauses: title, article, chapter and body, joined by blanks."""
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "article", "chapter", "body")]
    return df.select("key", F.trim(F.concat_ws(" ", *parts)).alias("text"))
