"""Reciprocal rank fusion of ranked lists, and search by vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.session import spread

RRF_K = 60
CANDIDATES = 400
#: Query vectors that one pass compares; more are searched in blocks.
QUERIES_AT_ONCE = 20_000


def hybrid(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """qid, key, bm25, cosine, rrf from two ranked lists (qid, key, rank, score): 1 / (60 + rank) from each side that
    holds the key; ranks are those of the whole lists, gaps kept; a missing side counts nothing and is null. Of the
    words only those are needed that can matter: the first of the list, and the keys that the other list holds."""
    a, b = words.select("qid", "key", F.col("rank").alias("ra"), F.col("score").alias("bm25")), vectors.select("qid", "key", F.col("rank").alias("rb"), F.col("score").alias("cosine"))
    side = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    return a.join(b, ["qid", "key"], "full_outer").select("qid", "key", "bm25", "cosine", F.round(side("ra") + side("rb"), 9).alias("rrf"))


def multi_route(lists: list[DataFrame], depth: int = 100) -> DataFrame:
    """qid, key, rrf summed over the first `depth` of each list (qid, key, rank)."""
    rows = lists[0].select("qid", "key", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("qid", "key", "rank"))
    return rows.filter(F.col("rank") <= depth).groupBy("qid", "key").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf"))


def top(rows: DataFrame, score: str, depth: int) -> DataFrame:
    """rank by score down, then key; the first `depth` of each qid."""
    w = W.partitionBy("qid").orderBy(F.desc(score), "key")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth)


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key, vec (array<double>) of non-null, non-zero, finite vectors of dim numbers; one row per key."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.filter(F.col(key).isNotNull() & good).groupBy(F.col(key).alias("key")).agg(F.min(v.cast("array<double>")).alias("vec"))


def vector_search(queries: DataFrame, index: DataFrame, dim: int, depth: int = CANDIDATES) -> DataFrame:
    """qid, key, rank, score (cosine, rounded to 6) of the `depth` nearest index vectors of each query.

    queries: qid, vec; index: key (unique), vec; vectors of another length are an error, null or zero ones are
    ignored. The queries are a stated set, compared in blocks with all rows: each partition keeps its own best (and ties with the
    last of them) through all its batches, a window over those makes the final lists. Ties go to the smaller key.
    """
    spark = queries.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERIES_AT_ONCE))
    source = spread(index.select("key", "vec"))
    id_type, key_type = dict(queries.dtypes)["qid"], dict(index.dtypes)["key"]
    out = None
    for p in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == p).select("qid", "vec").collect()
        rows = [r for r in rows if r.vec is not None and any(r.vec)]
        if any(len(r.vec) != dim for r in rows):
            raise ValueError("a query vector of another length")
        q = np.array([r.vec for r in rows], dtype=np.float64).reshape(len(rows), dim)
        q /= np.maximum(np.linalg.norm(q, axis=1)[:, None], 1e-300)
        shared = spark.sparkContext.broadcast(([r.qid for r in rows], q))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            least, seen = np.full(len(ids), -np.inf), 0  # the score a vector must reach, by what the partition has shown so far
            rows, places, scores, keys = [], [], [], []

            def cut() -> None:
                """Keep of each query the best `depth` and what ties with the last of them."""
                r, c, s = np.concatenate(rows), np.concatenate(places), np.concatenate(scores)
                order = np.lexsort((-s, r))
                r, c, s = r[order], c[order], s[order]
                begin = np.searchsorted(r, np.arange(len(ids) + 1))
                full = np.flatnonzero(np.diff(begin) >= depth)
                least[full] = s[begin[full] + depth - 1]
                keep = s >= least[r]
                rows[:], places[:], scores[:] = [r[keep]], [c[keep]], [s[keep]]

            for b in batches:
                b = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column("vec")), dim))
                if not b.num_rows or not ids:
                    continue
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                norm = np.linalg.norm(x, axis=1)
                s = np.round(q @ (x / np.where(norm > 0, norm, 1)[:, None]).T, 6)
                s[:, norm == 0] = -np.inf
                r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                rows.append(r)
                places.append(c + seen)
                scores.append(s[r, c])
                keys.append(b.column("key"))
                seen += b.num_rows
                cut()
            if seen:
                r, c, s = rows[0], places[0], scores[0]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in r]).cast(_arrow(id_type)), pa.chunked_array(keys).take(pa.array(c)).combine_chunks(), pa.array(s)], names=["qid", "key", "score"])

        part = source.mapInArrow(nearest, f"qid {id_type}, key {key_type}, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, "score", depth).select("qid", "key", "rank", "score")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def char_histogram(text: Column, dim: int) -> Column:
    """How often each residue of code points occurs in a text: a vector that needs no service, where none is given."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) % dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(codes, lambda c: c == d)).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles; null where one of them is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def segment_scores(pool: DataFrame, questions: DataFrame, clauses: DataFrame, segments: Column, vector: Callable[[Column], Column]) -> DataFrame:
    """qid, key, score per segment of the pool's clauses (qid, key): the cosine with the question (qid, text).

    segments: an array of texts over the columns of clauses; vector: the vector of a text, as a column. Each clause of the
    pool is cut and embedded once, however many questions it is asked for.
    """
    cut = clauses.join(pool.select("key").distinct(), "key", "left_semi").select("key", F.explode(segments).alias("text")).select("key", vector(F.col("text")).alias("v"))
    asked = questions.select("qid", vector(F.col("text")).alias("q"))
    return pool.select("qid", "key").join(asked, "qid").join(cut, "key").select("qid", "key", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))


def best_segment(hits: DataFrame, owner: str, depth: int) -> DataFrame:
    """qid, owner, score: candidates reordered by their most similar segment. hits: qid, key, score per segment."""
    best = hits.groupBy("qid", owner).agg(F.max("score").alias("score"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), owner)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth).select("qid", owner, "rank", "score")


def rerank_head(original: DataFrame, scores: DataFrame, pool: int = 20, mode: str = "fuse") -> DataFrame:
    """qid, key, rank: the first `pool` of a list reordered by scores (qid, key, score), the tail as it was.

    mode 'replace' takes the new order, 'fuse' sums 1 / (60 + rank) of both orders. Without any score of a question its
    order stays; ties keep the old order.
    """
    head = original.filter(F.col("rank") <= pool).join(scores.select("qid", "key", "score"), ["qid", "key"], "left")
    again = head.withColumn("new", F.row_number().over(W.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "rank")))
    value = F.col("new").cast("double") if mode == "replace" else -(1.0 / (RRF_K + F.col("rank")) + 1.0 / (RRF_K + F.col("new")))
    done = again.withColumn("at", F.row_number().over(W.partitionBy("qid").orderBy(F.round(value, 12), "rank"))).select("qid", "key", F.col("at").alias("rank"))
    return done.unionByName(original.filter(F.col("rank") > pool).select("qid", "key", "rank"))
