"""Whether an index still matches its corpus: fingerprints, differences, coverage, gate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions.hashing import clause_json, digest, nfkc

#: Hexadecimal digits that hashes of one part share, level by level: 65,536 parts, then 256, then one.
LEVELS = (4, 2)


def clause_hashes(df: DataFrame, normalize: bool = True) -> DataFrame:
    """key (law/article), hash (of law, article, body, status, layer, file), and the columns of the metadata hash.

    df: title, article, body, status, layer, file. Nulls are ''. normalize: NFKC, line ends and white space at the
    ends, in one vectorized call over the six columns; without it values count as stored and all stays in the JVM.
    """
    names = ["title", "article", "body", "status", "layer", "file"]
    t = df.select(*[(nfkc(F.col(c)) if normalize else F.coalesce(F.col(c), F.lit(""))).alias(c) for c in names])
    return t.select(
        F.concat("title", F.lit("/"), "article").alias("key"),
        digest(clause_json(F.col("title"), F.col("article"), F.col("body"), F.col("status"), F.col("layer"), F.col("file"))).alias("hash"), "status", "layer",
    )


def fingerprint(rows: DataFrame, *values: Column) -> DataFrame:
    """One row (fingerprint, rows): the same for any order of rows, another if any value changes.

    Values are hashed; the hashes are sorted and hashed within 65,536 parts, the parts' digests within 256, those in one: no
    task holds more than a part, where sorting all rows in one place would need them all.
    """
    line = F.sha2(F.to_json(F.array(*[F.coalesce(v, F.lit("")) for v in values])), 256)
    level = rows.select(line.alias("part")).groupBy("part").agg(F.count("*").alias("n")).withColumn("d", F.col("n").cast("string"))
    for digits in LEVELS:
        listed = F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit("="), "d"))), ",")
        level = level.groupBy(F.substr("part", F.lit(1), F.lit(digits)).alias("part")).agg(F.sha2(listed, 256).alias("d"), F.sum("n").alias("n"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit("="), "d"))), ",")
    return level.agg(F.concat(F.lit("sha256:"), F.sha2(listed, 256)).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))


def exact_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (fingerprint, rows): SHA-256 over the canonical JSON of all rows as objects of the columns, sorted by key and
    then by the others. Such a value is made one row after the other, so one task reads all rows; it sorts them on
    disk and holds none. Where nobody else must reproduce the value, fingerprint does without that."""
    names = sorted(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest_, n = hashlib.sha256(b"["), 0
        for pdf in batches:
            for line in pdf["line"]:
                digest_.update((b"," if n else b"") + line.encode())
                n += 1
        digest_.update(b"]")
        yield pd.DataFrame({"fingerprint": ["sha256:" + digest_.hexdigest()], "rows": [n]})

    order = ["key", *(c for c in names if c != "key")]
    lines = rows.select(*order).repartition(1).sortWithinPartitions(*order).select(F.to_json(F.struct(*names)).alias("line"))
    none = F.lit("sha256:" + hashlib.sha256(b"[]").hexdigest())
    made = lines.mapInPandas(run, "fingerprint string, rows long")  # no row where Spark sees that there is nothing to do
    return made.agg(F.coalesce(F.max("fingerprint"), none).alias("fingerprint"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))


def index_status(enabled: bool, present: bool, verified: Column, changed: Column, share: Column, least: float = 0.99) -> Column:
    """disabled, missing, unverified (no hashes compared yet), stale, uncovered or valid."""
    if not enabled or not present:
        return F.lit("disabled" if not enabled else "missing")
    return F.when(~verified, "unverified").when(changed > 0, "stale").when(share < least, "uncovered").otherwise("valid")


def audit_report(candidates: DataFrame, state: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """qid, audit: what was searched and how far it may be trusted, as JSON with stage, retrieval, index, verification and
    answer_gate. candidates: qid, candidates (how many); state: one row status, changed_clauses, as gate gives it.
    The changed clauses are counted; index_diff lists them."""
    rows = candidates.crossJoin(F.broadcast(state))  # one row
    uses = F.col("status") == "valid"
    return rows.select("qid", F.to_json(F.struct(
        F.when((F.col("candidates") > 0) | uses, "retrieved").otherwise("no_results").alias("stage"),
        F.struct(F.array(*[F.lit(x) for x in layers]).alias("layers"), F.when(uses, "bm25_vector_rrf").otherwise("bm25").alias("method"), F.col("candidates").alias("candidate_count"),
                 F.lit(any(x != "current" for x in layers)).alias("historical_included")).alias("retrieval"),
        F.struct(F.col("status"), (F.col("changed_clauses") == 0).alias("hash_match"), F.col("changed_clauses")).alias("index"),
        F.struct(F.lit(False).alias("metadata_checked"), F.lit(False).alias("live_checked")).alias("verification"),
        F.struct(F.when(F.col("status").isin("stale", "missing", "disabled"), "conditional").otherwise("allowed").alias("status"), F.lit(True).alias("allowed"), F.lit("retrieval_audit_only").alias("reason")).alias("answer_gate"),
    )).alias("audit"))


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change ('added', 'removed', 'changed') of the hashes that differ between two states (key, hash). Several rows
    of one key count as the set of their hashes."""
    one = lambda d, n: d.groupBy("key").agg(F.array_sort(F.collect_set("hash")).alias(n))
    both = one(old, "a").join(one(new, "b"), "key", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("key", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def coverage(current: DataFrame, index: DataFrame) -> DataFrame:
    """One row (keys, covered, share): how many of the current keys the index holds. Repeated keys count once."""
    keys = current.select("key").filter("key is not null").distinct()
    held = keys.join(index.select("key").distinct().withColumn("held", F.lit(1)), "key", "left")
    n, c = F.count("*"), F.coalesce(F.sum("held"), F.lit(0))
    return held.agg(n.alias("keys"), c.cast("long").alias("covered"), F.round(c / F.greatest(n, F.lit(1)), 6).alias("share"))


def gate(changed: DataFrame, share: DataFrame, enabled: bool = True, present: bool = True, least: float = 0.99) -> DataFrame:
    """One row: status of the index (disabled, missing, stale, uncovered, valid), how many clauses changed, whether
    vectors are used, and the answer gate ('conditional' unless the index is in use or merely uncovered)."""
    n = changed.agg(F.count("*").alias("changed_clauses")).select("changed_clauses", F.lit(None).cast("double").alias("share"))
    both = n.unionByName(share.select(F.lit(None).cast("long").alias("changed_clauses"), F.col("share").cast("double"))).agg(F.max("changed_clauses").alias("changed_clauses"), F.max("share").alias("share"))
    status = index_status(enabled, present, F.lit(True), F.col("changed_clauses"), F.col("share"), least)
    rows = both.withColumn("status", status)
    return rows.select("status", "changed_clauses", (F.col("status") == "valid").alias("uses_vectors"), F.when(F.col("status").isin("stale", "missing", "disabled"), "conditional").otherwise("allowed").alias("answer_gate"))
