"""What changed between consecutive full snapshots of a table.

Compact rows travel: a snapshot number, a 128-bit key hash and a 64-bit row hash. They are grouped into hash
buckets; inside a bucket numpy sorts them and takes set differences of neighbouring snapshots with searchsorted.
Full values are fetched afterwards for the keys that differ: of the other keys no value is shuffled while Spark can
broadcast the differing ones (its own size limit), beyond that its joins filter or sort both sides.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.functions.text import wide_hash
from lawmill.session import parallelism, staged

#: Compact rows that one bucket should hold: 36 bytes each in numpy.
ROWS_PER_BUCKET = 400_000

_DIFF = "sid int, k1 long, k2 long, change string, now_hash long, was_hash long"


def _codes(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """A dense number for each 128-bit key, in key order."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), dtype=np.int64)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    codes = np.empty(len(a), dtype=np.int64)
    codes[order] = np.cumsum(new) - 1
    return codes


def diff_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Differences of each snapshot to the one before it, for the keys of one bucket.

    Snapshots are numbered 1..n without gaps; one that has no row in this bucket is an empty set.
    """
    k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    sid, rh, n = pdf["sid"].to_numpy(), pdf["row_hash"].to_numpy(), int(pdf["n"].iloc[0])
    codes = _codes(k1, k2)
    order = np.lexsort((codes, sid))
    codes, sid, at = codes[order], sid[order], order
    edges = np.searchsorted(sid, np.arange(1, n + 2))
    found: list[tuple[int, np.ndarray, str, np.ndarray, np.ndarray]] = []
    none = np.empty(0, dtype=np.int64)
    for s in range(2, n + 1):
        was, now = slice(edges[s - 2], edges[s - 1]), slice(edges[s - 1], edges[s])
        a, b = codes[was], codes[now]
        ra, rb = at[was], at[now]
        if len(a):
            where = np.minimum(np.searchsorted(a, b), len(a) - 1)
            both = a[where] == b
        else:
            where, both = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=bool)
        if len(b):
            kept = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
        else:
            kept = np.zeros(len(a), dtype=bool)
        found.append((s, rb[~both], "added", rb[~both], none))
        found.append((s, ra[~kept], "removed", none, ra[~kept]))
        if both.any():
            now_at, was_at = rb[both], ra[where[both]]
            differ = rh[now_at] != rh[was_at]
            found.append((s, now_at[differ], "changed", now_at[differ], was_at[differ]))
    parts = []
    for s, at_key, change, now_at, was_at in found:
        if len(at_key):
            parts.append(
                pd.DataFrame(
                    {
                        "sid": np.int32(s), "k1": k1[at_key], "k2": k2[at_key], "change": change,
                        "now_hash": rh[now_at] if len(now_at) else pd.array([None] * len(at_key), dtype="Int64"),
                        "was_hash": rh[was_at] if len(was_at) else pd.array([None] * len(at_key), dtype="Int64"),
                    }
                ).astype({"now_hash": "Int64", "was_hash": "Int64"})
            )
    if not parts:
        return pd.DataFrame({"sid": np.empty(0, np.int32), "k1": none, "k2": none, "change": np.empty(0, object), "now_hash": pd.array([], "Int64"), "was_hash": pd.array([], "Int64")})
    return pd.concat(parts, ignore_index=True)


def snapshot_changes(
    df: DataFrame, snapshot: str, key: Column, compare: dict[str, Column], received: str, key_name: str = "key",
    buckets: int | None = None,
) -> DataFrame:
    """One row per key and snapshot in which the key was added, removed or changed against the snapshot before.

    Columns: snapshot, key_name, change, and for every compared value was_<name> and now_<name> (null on the side
    where the key is missing). Defined cases: rows with a null snapshot or a null key are ignored; of several rows of
    one snapshot and key the one received last counts (null received counts as first; on a tie the larger row hash,
    so repeated rows never matter); compared values are the caller's normal forms, null being a value; the snapshot
    before is the next smaller value present in the table, even if all its rows lack a key; the earliest snapshot
    yields nothing; an empty table yields nothing. Columns of df are read only through the given expressions, so
    extra columns of any name do no harm.
    """
    spark = df.sparkSession
    k1, k2 = wide_hash(key)
    source = df.select(
        F.col(snapshot).alias("snap"), key.alias("key"), k1.alias("k1"), k2.alias("k2"),
        F.coalesce(F.unix_micros(F.col(received).cast("timestamp")), F.lit(-(2**62))).alias("at"),
        F.xxhash64(*compare.values()).alias("row_hash"), F.struct(*[c.alias(n) for n, c in compare.items()]).alias("v"),
    ).filter("snap is not null")
    keyed = source.filter("key is not null")
    numbered = source.select("snap").distinct().select(
        "snap", F.row_number().over(W.orderBy("snap")).alias("sid"), F.count("*").over(W.partitionBy()).cast("int").alias("n")
    )
    compact = keyed.groupBy("snap", "k1", "k2").agg(F.max(F.struct("at", "row_hash")).alias("last")).select("snap", "k1", "k2", "last.row_hash")
    compact = staged(compact, "compact")
    if buckets is None:
        buckets = max(parallelism(spark), -(-compact.count() // ROWS_PER_BUCKET))
    diffs = (
        compact.join(numbered, "snap")
        .select("sid", "n", "k1", "k2", "row_hash", F.pmod("k1", F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(lambda pdf: diff_bucket(pdf), _DIFF)
    )
    # staged, so that Spark knows its size: while it is small the values of other keys are left behind before any shuffle
    diffs = staged(diffs, "diffs")
    wanted = diffs.select("sid", "k1", "k2", "change", F.explode(F.array(
        F.struct(F.lit(True).alias("now"), F.col("sid").alias("at_sid"), F.col("now_hash").alias("row_hash")),
        F.struct(F.lit(False).alias("now"), (F.col("sid") - 1).alias("at_sid"), F.col("was_hash").alias("row_hash")),
    )).alias("x")).select("sid", "k1", "k2", "change", "x.*").filter("row_hash is not null")
    keys = diffs.select("k1", "k2").distinct()
    held = keyed.join(keys, ["k1", "k2"], "left_semi").join(numbered.select("snap", F.col("sid").alias("at_sid")), "snap")
    values = held.groupBy("at_sid", "k1", "k2", "row_hash").agg(F.min(F.struct("key", "v")).alias("x"))
    full = wanted.join(values, ["at_sid", "k1", "k2", "row_hash"]).groupBy("sid", "k1", "k2", "change").agg(
        F.min("x.key").alias("key"), F.max(F.when(F.col("now"), F.col("x.v"))).alias("new"), F.max(F.when(~F.col("now"), F.col("x.v"))).alias("old")
    )
    sides = [F.col(f"{s}.{n}").alias(f"{p}_{n}") for n in compare for s, p in (("old", "was"), ("new", "now"))]
    return full.join(numbered.select("sid", "snap"), "sid").select(F.col("snap").alias(snapshot), F.col("key").alias(key_name), "change", *sides)
