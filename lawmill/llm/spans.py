"""Long exact spans shared between records, and what to remove so that each stays once.

Units are the lines and sentences of a text; their digests are grouped over the whole corpus (`repeated_units` is that
alone). A span of a wanted length may begin and end inside units, so each window of that length is filed under a seed: the
smallest digest of the whole units in it, or, where it holds none, of its pieces of PIECE characters. Seeds depend on the
window alone, so equal windows have equal seeds; only windows whose seed stands in several texts are hashed one by one
and grouped. No pair of texts is compared or joined: a window knows how many records hold it and which is the earliest.
Neighbouring windows held by the same records are one run. Equal texts are one text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.functions.text import wide_hash
from lawmill.llm.grams import Hasher, code_points, mix, units, window_seeds
from lawmill.session import parallelism, spread, staged

MIN_SPAN = 200
#: Characters of the pieces that stand in for units where a window holds none.
PIECE = 64
#: Rows of a seed from which on its windows are grouped one by one in Spark and not in one call.
HOT = 1000
#: Hashes of windows that one call groups; windows that one row holds.
HASHES_AT_ONCE, WINDOWS_IN_ROW = 250_000, 4096


def seeds(texts: DataFrame, least: int, piece: int) -> DataFrame:
    """t1, t2 (the text's hash) and seed: every seed of every text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(window_seeds(t, code_points(t), least, piece)) for t in b.column("text").to_pylist()]
            take = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            values = np.concatenate(own) if own else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("t1").take(take), b.column("t2").take(take), pa.array(values.view(np.int64))], names=["t1", "t2", "seed"])

    return spread(texts.select("t1", "t2", "text")).mapInArrow(run, "t1 long, t2 long, seed long")


def _hashed(held: DataFrame, least: int, piece: int) -> DataFrame:
    """seed, hot, first, copies, start, hashes (of consecutive windows, binary) of all windows with a shared seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seed, hot, start, hashes = [], [], [], [], []
            for i, (text, shared) in enumerate(zip(b.column("text").to_pylist(), b.column("shared").to_pylist(), strict=True)):
                chars = code_points(text)
                known = np.array([s["seed"] for s in shared], dtype=np.int64).view(np.uint64)
                order = np.argsort(known)
                known, is_hot = known[order], np.array([s["hot"] for s in shared])[order]
                own = window_seeds(text, chars, least, piece)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                on = known[at] == own
                every = Hasher.of(chars, 7).rolling(least)
                parts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                for lo, hi in zip(parts[:-1], parts[1:], strict=True):
                    for a in range(int(lo), int(hi), WINDOWS_IN_ROW) if on[lo] else ():
                        rows.append(i)
                        seed.append(own[lo].view(np.int64))
                        hot.append(bool(is_hot[at[lo]]))
                        start.append(a)
                        hashes.append(every[a : min(int(hi), a + WINDOWS_IN_ROW)].tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed, pa.int64()), pa.array(hot, pa.bool_()), b.column("first").take(take), b.column("copies").take(take), pa.array(start, pa.int32()), pa.array(hashes, pa.binary())],
                names=["seed", "hot", "first", "copies", "start", "hashes"],
            )

    return held.select("text", "shared", "first", "copies").mapInArrow(run, "seed long, hot boolean, first long, copies long, start int, hashes binary")


_RUN = "first long, start int, stop int, records long, lead long, s1 long, s2 long"


def group_windows(t: pa.Table) -> pa.Table:
    """Runs of windows that other texts hold too, from rows (seed, first, copies, start, hashes) of whole seeds.

    first, start, stop (numbers of windows), records (that hold them), lead (the earliest of these) and two numbers, s1
    and s2, that tell sets of holders apart.
    """
    raw = t.column("hashes").to_pylist()
    sizes = np.array([len(x) // 8 for x in raw], dtype=np.int64)
    row = np.repeat(np.arange(len(raw)), sizes)
    h = np.frombuffer(b"".join(raw), dtype=np.uint64)
    seed, first, copies = (t.column(c).to_numpy().astype(np.int64) for c in ("seed", "first", "copies"))
    place = t.column("start").to_numpy().astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((first[row], h, seed[row]))
    k, x, f, c = seed[row][order], h[order], first[row][order], copies[row][order]
    window = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (x[1:] != x[:-1])])) if len(k) else np.empty(0, np.int64)
    new = np.concatenate([[True], (window[1:] != window[:-1]) | (f[1:] != f[:-1])]) if len(k) else np.empty(0, bool)
    begins = np.flatnonzero(np.concatenate([[True], window[new][1:] != window[new][:-1]])) if len(k) else np.empty(0, np.int64)
    if not len(begins):
        return pa.table({n: pa.array([], p) for n, p in (("first", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), *((n, pa.int64()) for n in ("records", "lead", "s1", "s2")))})
    texts = np.diff(np.append(begins, new.sum()))
    sets = {
        "records": np.add.reduceat(c[new], begins), "lead": np.minimum.reduceat(f[new], begins), "s1": np.bitwise_xor.reduceat(mix(f[new].view(np.uint64)), begins).view(np.int64),
        "s2": np.bitwise_xor.reduceat(mix(f[new].view(np.uint64) ^ np.uint64(0x5BD1E995)), begins).view(np.int64) ^ texts,
    }
    back = np.empty(len(order), dtype=np.int64)
    back[order] = window
    keep = np.flatnonzero(texts[back] > 1)
    keep = keep[np.lexsort((place[keep], first[row][keep]))]
    f, p, w = first[row][keep], place[keep], back[keep]
    if not len(keep):
        return group_windows(t.slice(0, 0))
    one = np.concatenate([[True], (f[1:] != f[:-1]) | (p[1:] != p[:-1] + 1) | (sets["s1"][w][1:] != sets["s1"][w][:-1]) | (sets["s2"][w][1:] != sets["s2"][w][:-1])])
    at = np.flatnonzero(one)
    end = np.append(at[1:], len(keep)) - 1
    return pa.table({"first": f[at], "start": p[at].astype(np.int32), "stop": (p[end] + 1).astype(np.int32)} | {n: v[w[at]] for n, v in sets.items()})


def _group_hot(rows: DataFrame) -> DataFrame:
    """The same as group_windows for seeds of any number of rows: windows are rows, combined before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("hashes").to_pylist()
            sizes = np.array([len(x) // 8 for x in raw], dtype=np.int64)
            take = pa.array(np.repeat(np.arange(len(raw)), sizes))
            place = b.column("start").to_numpy()[take.to_numpy()] + np.arange(len(take)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column("seed").take(take), pa.array(np.frombuffer(b"".join(raw), dtype=np.int64)), b.column("first").take(take), b.column("copies").take(take), pa.array(place.astype(np.int32))],
                names=["seed", "h", "first", "copies", "at"],
            )

    each = staged(rows.mapInArrow(run, "seed long, h long, first long, copies long, at int"), "hot")
    holders = each.select("seed", "h", "first", "copies").distinct()
    sets = holders.groupBy("seed", "h").agg(
        F.sum("copies").alias("records"), F.min("first").alias("lead"), F.bit_xor(F.xxhash64("first")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(3), "first")).alias("s2"), F.count("*").alias("n")
    ).filter("n > 1")
    shared = each.select("seed", "h", "first", "at").join(sets.drop("n"), ["seed", "h"])
    w = W.partitionBy("first").orderBy("at")
    same = (F.lag("at").over(w) == F.col("at") - 1) & (F.lag("s1").over(w) == F.col("s1")) & (F.lag("s2").over(w) == F.col("s2"))
    run_ = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return shared.withColumn("run", run_).groupBy("first", "run", "records", "lead", "s1", "s2").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop")).select("first", "start", "stop", "records", "lead", "s1", "s2")


class SharedSpans:
    """The spans of at least `least` characters (code points) that occur verbatim in more than one record of df.

    Defined cases: null and shorter texts share nothing; a span repeated only inside one record is none; equal texts of
    at least that length share all of it; repeated rows of one id count once, of several texts of one id the longest
    counts (then the one of the larger hash); texts are compared whole and as stored. Only the two named columns are
    read, so further columns may have any name.
    """

    def __init__(self, df: DataFrame, doc: str, text: str, least: int = MIN_SPAN, piece: int = PIECE, hot: int = HOT) -> None:
        if not 8 <= piece < least:
            raise ValueError("a piece is shorter than the least span")
        self.least, spark = least, df.sparkSession
        t1, t2 = wide_hash(F.col(text))
        rows = df.select(F.col(doc).alias("doc"), t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text")).filter("doc is not null")
        chosen = rows.groupBy("doc").agg(F.max(F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("n"), "t1", "t2")).alias("m")).select("doc", "m.*")
        self.members = staged(chosen, "members")
        long = self.members.filter(F.col("n") >= least)
        self.texts = long.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc").cast("long").alias("first"), F.max("n").alias("n"))
        long_rows = rows.filter(F.length("text") >= least)
        filed = staged(seeds(long_rows, least, piece), "seeds")
        seen = filed.groupBy("seed").agg(F.min("t1").alias("x1"), F.max("t1").alias("y1"), F.min("t2").alias("x2"), F.max("t2").alias("y2"), F.count("*").alias("rows"))
        seen = seen.filter("x1 <> y1 or x2 <> y2").select("seed", (F.col("rows") >= hot).alias("hot"))
        shared = filed.join(seen, "seed").groupBy("t1", "t2").agg(F.collect_set(F.struct("seed", "hot")).alias("shared"))
        shared = staged(shared.join(self.texts, ["t1", "t2"]), "shared")
        held = long_rows.join(shared.select("t1", "t2"), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
        hashed = staged(_hashed(held.join(shared, ["t1", "t2"]), least, piece), "windows")
        sizes = hashed.agg(F.sum(F.length("hashes") / 8).alias("n"), F.max("hot").alias("hot")).first()
        buckets = max(parallelism(spark), int((sizes["n"] or 0) // HASHES_AT_ONCE) + 1)
        cool = hashed.filter("not hot").withColumn("bucket", F.pmod(F.xxhash64("seed"), F.lit(buckets)))
        runs = cool.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(group_windows, _RUN)
        if sizes["hot"]:
            runs = runs.unionByName(_group_hot(hashed.filter("hot")))
        self.runs = staged(runs, "runs")

    def pairs(self) -> DataFrame:
        """Every pair of records, doc_id_a < doc_id_b, that shares a span. Sets of holders are listed once each, however
        many windows they share; the pairs themselves are what is asked for."""
        held = self.runs.select("s1", "s2", "records", "first").distinct()
        a, b = held.alias("a"), held.alias("b")
        cross = a.join(b, (F.col("a.s1") == F.col("b.s1")) & (F.col("a.s2") == F.col("b.s2")) & (F.col("a.records") == F.col("b.records")) & (F.col("a.first") < F.col("b.first")))
        cross = cross.select(F.col("a.first").alias("x"), F.col("b.first").alias("y")).distinct()
        m = self.members.filter(F.col("n") >= self.least).join(self.texts.select("t1", "t2", "first", "copies"), ["t1", "t2"]).select(F.col("doc").alias("doc"), "first", "copies")
        of = lambda n: m.select(F.col("first").alias(n), F.col("doc").alias(f"{n}_doc"))
        pairs = cross.join(of("x"), "x").join(of("y"), "y").select("x_doc", "y_doc")
        twins = m.filter("copies > 1")
        s, t = twins.alias("s"), twins.alias("t")
        pairs = pairs.unionByName(s.join(t, (F.col("s.first") == F.col("t.first")) & (F.col("s.doc") < F.col("t.doc"))).select(F.col("s.doc").alias("x_doc"), F.col("t.doc").alias("y_doc")))
        return pairs.select(F.least("x_doc", "y_doc").alias("doc_id_a"), F.greatest("x_doc", "y_doc").alias("doc_id_b"))

    def _covered(self, runs: DataFrame) -> DataFrame:
        """first, start, end: the characters in the windows of runs, as stretches that do not touch."""
        w = W.partitionBy("first").orderBy("start", "stop")
        reach = runs.select("first", "start", (F.col("stop") - 1 + self.least).alias("stop")).withColumn("reach", F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)))
        part = reach.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
        return part.groupBy("first", "part").agg(F.min("start").alias("start"), F.max("stop").alias("end")).select("first", "start", "end")

    def shares(self) -> DataFrame:
        """One row per record: n_chars, shared_chars (in spans held by another record), share, and most_holders, the
        largest number of other records that hold one and the same span of it."""
        covered = self._covered(self.runs).groupBy("first").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
        held = self.runs.groupBy("first").agg(F.max("records").alias("records"))
        per = self.texts.join(covered, "first", "left").join(held, "first", "left").select("t1", "t2", "copies", "covered", "records")
        rows = self.members.join(per, ["t1", "t2"], "left")
        shared = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("covered", F.lit(0)))
        return rows.select(
            F.col("doc").alias("doc_id"), F.col("n").alias("n_chars"), shared.cast("long").alias("shared_chars"), F.when(F.col("n") > 0, shared / F.col("n")).otherwise(F.lit(0.0)).alias("share"),
            (F.greatest(F.coalesce("records", F.lit(1)), F.coalesce("copies", F.lit(1))) - 1).cast("long").alias("most_holders"),
        )

    def removals(self) -> DataFrame:
        """What to cut so that each span stays only in its earliest record: doc_id, start, end (offsets in the stored
        text). The earliest record is the one of the smallest id; a copy of an earlier text goes whole."""
        cut = self._covered(self.runs.filter("lead < first")).select(F.col("first").alias("doc"), "start", "end")
        later = self.members.join(self.texts.filter("copies > 1").select("t1", "t2", "first"), ["t1", "t2"]).filter("doc <> first")
        return cut.unionByName(later.select("doc", F.lit(0).alias("start"), F.col("n").alias("end"))).select(F.col("doc").alias("doc_id"), "start", "end")


def repeated_units(df: DataFrame, doc: str, text: str, kept: bool = False) -> DataFrame:
    """Lines and sentences that stood before: doc_id, start, end (offsets in the stored text) of every one but the
    earliest, by id and then by place; with kept of the earliest of those that come again.

    Units are cut at line ends and at 。；！？.;!? and compared without blanks at their ends; shorter ones than LEAST_UNIT
    characters are left alone. Nulls have no units; repeated rows of one id count as one text if equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found, h1, h2 = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                begin, end = units(text)
                chars = code_points(text)
                rows.append(np.full(len(begin), i))
                found.append((begin, end))
                h1.append(Hasher.of(chars).between(begin, end))
                h2.append(Hasher.of(chars, 7).between(begin, end))
            cat = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(h1, np.uint64).view(np.int64)), pa.array(cat(h2, np.uint64).view(np.int64)), b.column("doc").take(pa.array(cat(rows, np.int64))),
                 pa.array(cat([a for a, _ in found], np.int32)), pa.array(cat([z for _, z in found], np.int32))],
                names=["h1", "h2", "doc", "start", "end"],
            )

    rows = spread(df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null"))
    each = staged(rows.mapInArrow(run, "h1 long, h2 long, doc long, start int, end int"), "units")
    first = each.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("m"), F.max(F.struct("doc", "start")).alias("last")).filter("m <> last").select("h1", "h2", "m")
    place = F.struct("doc", "start")
    hit = each.join(first, ["h1", "h2"]).filter((place == F.col("m")) if kept else (place > F.col("m")))
    return hit.select(F.col("doc").alias("doc_id"), "start", "end").distinct()
