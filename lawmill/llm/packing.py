"""Filling fixed-capacity containers with texts measured in tokens, by shortest-pack-first over the length histogram.

Only the histogram of lengths reaches the driver, at most `capacity` rows a container kind, whatever the corpus; the patterns made of it
have about three rows for each. The
lengths are placed longest first, each into the emptiest kind of pack that has room, all equal packs at once. The
resulting patterns say which ranks of each length go into which containers; texts are ranked within their length and
joined to the patterns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.session import spread, staged

#: Texts of one length that one task ranks; of longer lists each task ranks some of the PARTS.
RANKED_AT_ONCE = 100_000
#: Parts, by a hash of the id, in whose order texts of one length are ranked, at every size.
PARTS = 4096
#: Ranks in a block of the join of texts with patterns.
BLOCK = 64
MOST_KINDS = 1000


@cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(df: DataFrame, doc: str, text: str, tokenizer: str) -> DataFrame:
    """doc, n_tokens: one row per id that is not null; null and empty texts have 0 tokens; of repeated ids the longest
    text counts. tokenizer is the path of a sentencepiece model, the same on every machine."""
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            counts = [len(ids) for lo in range(0, len(texts), 256) for ids in model.encode(texts[lo : lo + 256], num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(counts, pa.int32())], names=["doc", "n_tokens"])

    rows = spread(df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc is not null"))
    return rows.mapInArrow(run, "doc long, n_tokens int").groupBy("doc").agg(F.max("n_tokens").alias("n_tokens"))


def pack_histogram(lengths: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how many packs, {length: items a pack}) that hold every item of the histogram once.

    A pack kind is a chain of items; kinds of equal free space wait under that space. Each step either uses up the
    items of a length or all packs of a kind, so kinds number at most twice the distinct lengths.
    """
    waiting: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    item, parent = [0], [-1]

    def put(count: int, node: int, free: int) -> None:
        if free not in waiting:
            waiting[free] = []
            heapq.heappush(spaces, -free)
        waiting[free].append((count, node))

    for length in sorted(lengths, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("a length outside 1..capacity")
        left = lengths[length]
        while left:
            while spaces and not waiting.get(-spaces[0]):
                waiting.pop(-heapq.heappop(spaces), None)
            if spaces and -spaces[0] >= length:
                free = -spaces[0]
                count, node = waiting[free].pop()
                used = min(count, left)
                if count > used:
                    waiting[free].append((count - used, node))
            else:
                # no pack has room: new ones, each filled with as many of this length as an even spread asks for
                free, node, used = capacity, 0, min(left, -(-left // (capacity // length)))
            item.append(length)
            parent.append(node)
            left -= used
            put(used, len(item) - 1, free - length)
    out = []
    for kinds in waiting.values():
        for count, node in kinds:
            pattern: dict[int, int] = {}
            while node:
                pattern[item[node]] = pattern.get(item[node], 0) + 1
                node = parent[node]
            out.append((count, pattern))
    return out


def _places(hist: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """For each length the ranges of ranks and where they go: length, first, items (ranks in all), each (in a pack), base."""
    rows, base, used = [], 0, dict.fromkeys(hist["length"], 0)
    for count, pattern in pack_histogram(dict(zip(hist["length"].astype(int), hist["n"].astype(int), strict=True)), capacity):
        for length, each in pattern.items():
            rows.append((length, used[length], count * each, each, base))
            used[length] += count * each
        base += count
    return pd.DataFrame(rows, columns=["length", "first", "items", "each", "base"])


def pack_texts(counts: DataFrame, containers: DataFrame, kind: str = "container_kind", capacity: str = "capacity") -> DataFrame:
    """Where every text goes: container_kind, container_id, doc_id, piece, token_from, token_to (exclusive).

    counts: doc, n_tokens. A text longer than the capacity is cut into whole containers and a rest, which is packed
    like a text; no other text is split. Texts without tokens are laid nowhere. Kinds with a null or non-positive
    capacity are ignored; of repeated kinds the largest capacity counts. Equal lengths are interchangeable, and ranks
    go by a hash group and then by id, so the result depends on the rows alone.
    """
    spark = counts.sparkSession
    kinds = containers.filter(F.col(kind).isNotNull() & (F.col(capacity) > 0)).groupBy(F.col(kind).alias("kind")).agg(F.max(capacity).alias("cap")).limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    options = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(int(r.cap)).alias("cap")) for r in kinds]) if kinds else F.expr("cast(array() as array<struct<kind:string,cap:int>>)")
    pieces = counts.filter("n_tokens > 0").select("doc", "n_tokens", F.explode(options).alias("o")).select("doc", "n_tokens", "o.kind", "o.cap")
    whole = pieces.filter("n_tokens > cap").select("kind", "doc", "cap", F.explode(F.expr("sequence(0, cast(n_tokens div cap as int) - 1)")).alias("piece"))
    whole = whole.select(
        "kind", F.concat(F.lit("whole-"), F.col("doc"), F.lit("-"), F.col("piece")).alias("container_id"), "doc", "piece",
        (F.col("piece") * F.col("cap")).alias("token_from"), ((F.col("piece") + 1) * F.col("cap")).alias("token_to"),
    )
    rest = pieces.select("kind", "doc", "n_tokens", F.expr("if(n_tokens > cap, cast(n_tokens div cap as int), 0)").alias("piece"), F.expr("if(n_tokens > cap, n_tokens % cap, n_tokens)").alias("length")).filter("length > 0")
    hist = rest.groupBy("kind", "length").agg(F.count("*").alias("n")).toPandas()
    caps = {r.kind: int(r.cap) for r in kinds}
    places = [_places(h, caps[k]).assign(kind=k) for k, h in hist.groupby("kind")]
    goes = spark.createDataFrame(
        pd.concat(places, ignore_index=True) if places else pd.DataFrame({c: [] for c in ("length", "first", "items", "each", "base", "kind")}),
        "length int, first long, items long, each int, base long, kind string",
    )
    goes = goes.withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + items - 1) div {BLOCK})")))
    hot = spark.createDataFrame(hist[hist["n"] > RANKED_AT_ONCE][["kind", "length"]], "kind string, length int").withColumn("hot", F.lit(True))
    parted = rest.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int"))
    parted = parted.join(F.broadcast(hot), ["kind", "length"], "left")  # lengths: no more than the capacities together
    # texts are ranked by part and id; of a hot length each part is ranked alone and the parts before it are added
    own = F.when(F.col("hot"), F.col("part")).otherwise(-1)
    sizes = parted.filter("hot").groupBy("kind", "length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("kind", "length", "part", (F.sum("n").over(W.partitionBy("kind", "length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = parted.withColumn("rank", F.row_number().over(W.partitionBy("kind", "length", own).orderBy("part", "doc")) - 1).join(before, ["kind", "length", "part"], "left")
    ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).withColumn("block", F.expr(f"rank div {BLOCK}"))
    r, g = ranked.alias("r"), goes.alias("g")
    laid = r.join(g.hint("merge"), (F.col("r.kind") == F.col("g.kind")) & (F.col("r.length") == F.col("g.length")) & (F.col("r.block") == F.col("g.block"))
                  & (F.col("r.rank") >= F.col("g.first")) & (F.col("r.rank") < F.col("g.first") + F.col("g.items")))
    laid = laid.select(
        F.col("r.kind").alias("kind"), F.concat(F.lit("pack-"), F.expr("g.base + (r.rank - g.first) div g.each")).alias("container_id"), F.col("r.doc").alias("doc"),
        F.col("r.piece").alias("piece"), (F.col("r.n_tokens") - F.col("r.length")).alias("token_from"), F.col("r.n_tokens").alias("token_to"),
    )
    return whole.unionByName(laid).select(F.col("kind").alias("container_kind"), "container_id", F.col("doc").alias("doc_id"), "piece", "token_from", "token_to")


def container_fill(assigned: DataFrame, containers: DataFrame, kind: str = "container_kind", capacity: str = "capacity") -> DataFrame:
    """One row per container: container_kind, container_id, texts, tokens, capacity, fill."""
    caps = containers.groupBy(F.col(kind).alias("container_kind")).agg(F.max(capacity).alias("capacity"))
    per = assigned.groupBy("container_kind", "container_id").agg(F.count("*").alias("texts"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    return per.join(caps, "container_kind").withColumn("fill", F.col("tokens") / F.col("capacity"))


def packed(df: DataFrame, doc: str, text: str, containers: DataFrame, tokenizer: str) -> DataFrame:
    return pack_texts(staged(token_counts(df, doc, text, tokenizer), "tokens"), containers)
