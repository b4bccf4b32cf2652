"""BM25 over weighted terms, for batches of questions and of their routes at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.operators.terms import GRAM, PHRASE
from lawmill.session import spread, staged

K1, B = 1.2, 0.6
DF_CEILING, DF_CEILING_LEAST, DF_FLOOR_SHARE = 0.05, 50, 0.02
TITLE_BONUS = 1.5
#: Distinct terms that one broadcast automaton holds; more are counted in further passes.
TERMS_AT_ONCE = 1_000_000

_AUTOMATA: dict = {}


def _automaton(shared):
    """The automaton of a broadcast list of (term, hash) pairs, built once in each worker: it yields (number, length)."""
    mark, words, codes = shared.value
    if mark not in _AUTOMATA:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, (i, len(w)))
        if words:
            automaton.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[mark] = automaton
    return _AUTOMATA[mark], codes


def _counted(body: str, automaton) -> dict[int, list[int]]:
    """{term number: [occurrences without overlaps, end of the last]}."""
    tf: dict[int, list[int]] = {}
    for end, (i, n) in automaton.iter(body):
        have = tf.get(i)
        if have is None:
            tf[i] = [1, end]
        elif end - n >= have[1]:
            have[0] += 1
            have[1] = end
    return tf


def _passes(clauses: DataFrame, terms: DataFrame, search: Callable, schema: str) -> DataFrame:
    """search(automaton, codes, batch) over all clauses for all distinct terms, split by hash over passes."""
    distinct = terms.select("term").filter("term <> ''").distinct()
    words = [(r.term, r.code) for r in distinct.select("term", F.xxhash64("term").alias("code")).limit(TERMS_AT_ONCE + 1).collect()]
    passes = 1 if len(words) <= TERMS_AT_ONCE else -(-distinct.count() // (TERMS_AT_ONCE // 2))
    source, out = spread(clauses), None
    for p in range(passes):
        if passes > 1:
            part = distinct.filter(F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(passes)) == p)
            words = [(r.term, r.code) for r in part.select("term", F.xxhash64("term").alias("code")).collect()]
        shared = clauses.sparkSession.sparkContext.broadcast((uuid.uuid4().int, [w for w, _ in words], [c for _, c in words]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            if shared.value[1]:
                automaton, codes = _automaton(shared)
                for b in batches:
                    yield search(automaton, codes, b)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def document_frequencies(clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """term_code, df: in how many clauses each term occurs (absent: in none); counted per batch before anything is shuffled."""

    def search(automaton, codes: list[int], b: pa.RecordBatch) -> pa.RecordBatch:
        df: dict[int, int] = {}
        for body in b.column("body").to_pylist():
            for i in {i for _, (i, _) in automaton.iter(body)} if body else ():
                df[i] = df.get(i, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array([codes[i] for i in df], pa.int64()), pa.array(list(df.values()), pa.int64())], names=["term_code", "df"])

    return _passes(clauses.select("body"), terms, search, "term_code long, df long").groupBy("term_code").agg(F.sum("df").alias("df"))


def term_frequencies(clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """The clauses' columns but title and body, with term_code, tf, in_title and n_chars, for each term in a clause's body.

    clauses: title, body and any others; null texts count as empty. One pass finds all terms with an automaton (Aho-Corasick), so
    the cost follows the text and not the number of terms; term sets beyond TERMS_AT_ONCE are split by hash over passes.
    """
    names = [c for c in clauses.columns if c != "body"]
    types = dict(clauses.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", term_code long, tf int, in_title boolean, n_chars int"

    def search(automaton, codes: list[int], b: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, tfs, titled, sizes = [], [], [], [], []
        titles, seen_titles = b.column("title").to_pylist(), {}
        for r, body in enumerate(b.column("body").to_pylist()):
            tf = _counted(body, automaton) if body else {}
            if not tf:
                continue
            t = titles[r] or ""
            if t not in seen_titles:
                seen_titles[t] = {i for _, (i, _) in automaton.iter(t)}
            rows += [r] * len(tf)
            ids += tf
            tfs += [x[0] for x in tf.values()]
            titled += [i in seen_titles[t] for i in tf]
            sizes += [len(body)] * len(tf)
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(b.column(c).take(take) for c in names), pa.array([codes[i] for i in ids], pa.int64()), pa.array(tfs, pa.int32()), pa.array(titled, pa.bool_()), pa.array(sizes, pa.int32())],
            names=[*names, "term_code", "tf", "in_title", "n_chars"],
        )

    return _passes(clauses, terms, search, schema)


def df_band(df: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """terms with term_code, df, floor, ceiling, used: whether a term is neither too rare nor too common to count."""
    floor = F.least(F.when(F.col("kind") == GRAM, F.col("min_df")).otherwise(1), F.lit(max(1, int(DF_FLOOR_SHARE * total))))
    ceiling = F.greatest(F.lit(DF_CEILING * total) * F.when(F.col("kind") == PHRASE, 0.5).otherwise(1.0), F.lit(float(DF_CEILING_LEAST)))
    coded = terms.withColumn("term_code", F.xxhash64("term"))
    with_df = coded.join(df, "term_code", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("floor", floor).withColumn("ceiling", ceiling)
    return with_df.withColumn("used", (F.col("df") >= F.col("floor")) & (F.col("df") <= F.col("ceiling")))


def bm25(clauses: DataFrame, terms: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """by, key, title, article, score for every clause that a question's used terms occur in.

    clauses: key (unique), title, article, body; terms: by, term, weight, kind, min_df. Frequencies are counted first, so
    that terms too common or too rare never become rows. Empty clause sets give no rows; a term in both title and body
    earns a bonus. Terms of several routes of a question are counted in the same passes: name the route in `by`.
    """
    stats = clauses.agg(F.count("*").alias("n"), F.avg(F.length(F.coalesce("body", F.lit("")))).alias("average")).first()
    band = df_band(document_frequencies(clauses, terms), terms, stats["n"]).filter("used and df > 0")
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    used = staged(band.select(*by, "term", "term_code", "weight", idf.alias("idf")), "used")
    hits = term_frequencies(clauses.select("key", "title", "article", "body"), used)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n_chars") / F.lit(stats["average"] or 1.0))
    part = F.col("weight") * F.col("idf") * (F.col("tf") * (K1 + 1) / norm + F.when(F.col("in_title"), TITLE_BONUS).otherwise(0.0))
    scored = hits.join(used, "term_code").groupBy(*by, "key").agg(F.round(F.sum(part), 6).alias("score"), F.first("title").alias("title"), F.first("article").alias("article"))
    return scored.filter("score > 0").select(*by, "key", "title", "article", "score")


def ranked(scores: DataFrame, depth: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first `depth` clauses of each question with their rank: score down, then title, article and key."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), "title", "article", "key")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth).select(*by, "rank", "key", "score", "title", "article")


def ranks_of(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, key, rank, score of the wanted keys (qid, key: few per question) in the whole ranking of scores.

    Nothing is sorted as a whole: each score finds its place among the wanted ones of its question by halving, places are
    counted, and a rank is the sum of the counts before it. A wanted key without a score has no rank.
    """
    own = F.struct((-F.col("score")).alias("s"), "title", "article", "key")
    lists = scores.join(wanted.select("qid", "key"), ["qid", "key"], "left_semi").groupBy("qid").agg(F.array_sort(F.collect_list(own)).alias("list"))
    both = scores.join(lists, "qid").select("qid", own.alias("x"), "list")
    halved = lambda a: (a["lo"] + a["hi"]).cast("int") / 2
    step = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get("list", F.floor(halved(a)).cast("int")) < F.col("x"), F.struct((F.floor(halved(a)) + 1).cast("int").alias("lo"), a["hi"].alias("hi"))).otherwise(
        F.struct(a["lo"].alias("lo"), F.floor(halved(a)).cast("int").alias("hi")))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("list") + 1)).cast("int"))
    place = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size("list").alias("hi")), step)["lo"]
    counts = both.select("qid", place.alias("i")).groupBy("qid", "i").agg(F.count("*").alias("n"))
    before = counts.join(lists.select("qid", F.posexplode("list").alias("i", "x")), ["qid", "i"], "full_outer")
    rank = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("qid").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return before.withColumn("rank", rank).filter("x is not null").select("qid", F.col("x.key").alias("key"), F.col("rank").cast("int").alias("rank"), (-F.col("x.s")).alias("score"))
