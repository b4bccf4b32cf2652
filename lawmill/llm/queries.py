"""Queries of the operators in this package, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawmill.llm import grams, leaks, linkage, lookalike, neighbors, packing, spans
from lawmill.operators import fusion
from lawmill.session import staged, table


def _form_keys(spark: SparkSession, d: str) -> DataFrame:
    clauses, laws = table(spark, d, "audit_state"), table(spark, d, "build_from_downloads")
    return lookalike.form_keys(
        [("audit_state.body", clauses, "row_id", "body", None), ("audit_state.article", clauses, "row_id", "article", "file"),
         ("build_from_downloads.title", laws, "row_id", "title", "file")], "forms",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_form_keys(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(_form_keys(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audit_state").select("row_id", "body", "article")
    return lookalike.consistent_form(rows, {"body": "body_form", "article": "article_form"}).select("row_id", "body_form", "article_form")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest(table(spark, d, "build_vectors"), "keys", "vectors", 64, 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.close_pairs(_nearest(spark, d), 0.9)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).withColumn("cosine", F.round("cosine", 6))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """The accuracy loss against brute force, on the vectors whose key's checksum is divisible by 50: whether nine in ten of
    the five nearest are found (by cosine, so that ties count), and how many of those with a cosine of 0.9 are missed."""
    rows = fusion.usable_vectors(table(spark, d, "build_vectors"), "keys", "vectors", 64).withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    rows = staged(rows, "usable")
    asked = rows.filter(F.crc32("key") % 50 == 0).select(F.col("key").alias("qid"), "vec")
    true = fusion.vector_search(asked, rows, 64, 6).filter("qid <> key")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter("n <= 5")
    own = _nearest(spark, d).select(F.col("key").alias("qid"), F.round("cosine", 6).alias("c"), "rank")
    found = own.join(asked.select("qid"), "qid", "left_semi").groupBy("qid").agg(F.sort_array(F.collect_list("c"), asc=False).alias("found"))
    want = true.groupBy("qid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("true"))
    both = want.join(found, "qid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<double>")))
    hit = lambda x: F.size(F.filter("found", lambda c: c >= x - 2e-6)) >= F.size(F.filter("true", lambda c: c >= x))
    counts = both.select(F.size("true").alias("n"), F.size(F.filter("true", hit)).alias("hits"), F.size(F.filter("true", lambda x: (x >= 0.9) & ~hit(x))).alias("missed"))
    return counts.agg((F.sum("hits") >= 0.9 * F.sum("n")).alias("enough"), F.sum("missed").alias("close_missed"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.linked(table(spark, d, "build_from_downloads"), table(spark, d, "fetch_local_meta"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).filter("confidence > 0.5").select("file", "bbbs")


def tokenizer() -> str:
    """A public sentencepiece model of 32,000 pieces, as installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def p6_assign(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "containers"), tokenizer())


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of an assignment, by kind: texts laid, containers above capacity, texts split that fit, texts with a token
    twice or nowhere, and whether there are more than 1.02 times the fewest containers."""
    counts = staged(packing.token_counts(table(spark, d, "documents"), "doc_id", "text", tokenizer()), "tokens")
    kinds = table(spark, d, "containers")
    laid = staged(packing.pack_texts(counts, kinds), "packed")
    fill = packing.container_fill(laid, kinds).groupBy("container_kind", "capacity").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    span = F.col("token_to") - F.col("token_from")
    per = laid.groupBy("container_kind", "doc_id").agg(F.sum(span).alias("laid"), F.min("token_from").alias("lo"), F.max("token_to").alias("hi"), F.count("*").alias("pieces"), F.countDistinct("token_from").alias("begins"))
    per = per.join(counts.withColumnRenamed("doc", "doc_id"), "doc_id").join(kinds.groupBy("container_kind").agg(F.max("capacity").alias("cap")), "container_kind")
    whole = (F.col("laid") == F.col("n_tokens")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_tokens")) & (F.col("begins") == F.col("pieces"))
    texts = per.groupBy("container_kind").agg(F.count("*").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("cap"))).alias("split"), F.count_if(~whole).alias("torn"))
    return fill.join(texts, "container_kind").select("container_kind", "capacity", "texts", "overfull", "split", "torn", (F.col("containers") > F.ceil(1.02 * F.ceil(F.col("tokens") / F.col("capacity")))).alias("wasteful"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(staged(p6_assign(spark, d), "packed"), table(spark, d, "containers"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    fill = p6_fill(spark, d).groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("texts").alias("pieces"), F.sum("tokens").alias("tokens"))
    return fill.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_queries"), "item_id", ["question", "passage"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("run > 0").select("item_id", "doc_id")


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("run > 0").select("item_id", "doc_id", "run")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id", "edits")


def _spans(spark: SparkSession, d: str) -> spans.SharedSpans:
    return spans.SharedSpans(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).pairs()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).shares()


def p8_removals(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).removals()


def p8_units(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_units(table(spark, d, "documents"), "doc_id", "text")


_FORMS_CTE = f"""
with rows as (
  select 'audit_state.body' as field, row_id as id, '' as scope, body as raw from audit_state where body is not null
  union all select 'audit_state.article', row_id, '=' || coalesce(file, '~'), article from audit_state where article is not null
  union all select 'build_from_downloads.title', row_id, '=' || coalesce(file, '~'), title from build_from_downloads where title is not null),
forms as (select field, id, scope, raw, {lookalike.form_sql('raw')} as form from rows)
"""

_NEAREST_SQL = """
v as (select keys as key, min(vectors::double[]) as vec from build_vectors
      where keys is not null and len(vectors) = 64 and len(list_filter(vectors, lambda x: x <> 0)) > 0 group by keys),
near as (select * from (select a.key as a, b.key as b, list_cosine_similarity(a.vec, b.vec) as cosine,
           row_number() over (partition by a.key order by round(list_cosine_similarity(a.vec, b.vec), 9) desc, b.key) as rank
         from v a, v b where a.key <> b.key) where rank <= 5)"""
_COMPARED = lambda c: rf"regexp_replace(lower(nfc_normalize({lookalike._translate(c, lookalike.width_map())})), '[^\pL\pN]', '', 'g')"
_LEAKS_SQL = f"""
items as (select item_id, {_COMPARED('t')} as t from (select item_id, question as t from eval_queries union all select item_id, passage from eval_queries) where t is not null),
item_runs as (select distinct item_id, substr(t, i, 40) as g from (select item_id, t, unnest(range(1, length(t) - 38)) as i from items where length(t) >= 40)),
texts as (select doc_id, {_COMPARED('text')} as t from documents where text is not null),
doc_runs as (select doc_id, substr(t, i, 40) as g from (select doc_id, t, unnest(range(1, length(t) - 38)) as i from texts where length(t) >= 40))"""
_SPANS_SQL = """
grams as (select doc_id, i, hash(substr(text, i, 200)) as g from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)),
shared as (select g from grams group by g having min(doc_id) <> max(doc_id)),
held as (select g.doc_id, g.i, g.g from grams g join shared s on g.g = s.g)"""
_STRIPPED = r"regexp_replace(x, '^[\s\x{1c}-\x{1f}\x{85}\pZ]+|[\s\x{1c}-\x{1f}\x{85}\pZ]+$', '', 'g')"
_LEFT = r"length(regexp_extract(x, '^[\s\x{1c}-\x{1f}\x{85}\pZ]*'))"

QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall, "p6_assign": p6_assign, "p6_fill": p6_fill, "p6_summary": p6_summary, "p6_checks": p6_checks, "p7_found": p7_found, "p7_runs": p7_runs, "p7_near": p7_near, "p2_found": p2_found, "p2_classes": p2_classes, "p2_forms": p2_forms, "p8_found": p8_found, "p8_shares": p8_shares, "p8_removals": p8_removals, "p8_units": p8_units}
SQL = {
    "p2_found": _FORMS_CTE + "select a.field, a.id as id_a, b.id as id_b from forms a join forms b on a.field = b.field and a.scope = b.scope and a.form = b.form and a.id < b.id and a.raw <> b.raw",
    "p2_classes": _FORMS_CTE + ", classes as (select field, scope, form, min(id) as class_id, count(*) as class_rows from forms group by all having min(raw) <> max(raw)) select f.field, f.id, class_id, class_rows from forms f join classes c on f.field = c.field and f.scope = c.scope and f.form = c.form",
    "p2_forms": f"select row_id, {lookalike.form_sql('body')} as body_form, {lookalike.form_sql('article')} as article_form from audit_state",
    "p3_found": f"with {_NEAREST_SQL} select distinct least(a, b) as key_a, greatest(a, b) as key_b from near where cosine >= 0.9",
    "p3_recall": "select true as enough, 0::bigint as close_missed",
    "p6_checks": "select container_kind, capacity, (select count(distinct doc_id) from documents where length(text) > 0) as texts, 0::bigint as overfull, 0::bigint as split, 0::bigint as torn, false as wasteful from containers",
    "p7_found": f"with {_LEAKS_SQL} select distinct item_id, doc_id from item_runs join doc_runs using (g)",
    "p7_runs": f"""with {_LEAKS_SQL},
      item_at as (select item_id, p, i, substr(t, i, 40) as g from (select item_id, t, row_number() over () as p, unnest(range(1, length(t) - 38)) as i from items where length(t) >= 40)),
      doc_at as (select doc_id, i, substr(t, i, 40) as g from (select doc_id, t, unnest(range(1, length(t) - 38)) as i from texts where length(t) >= 40)),
      hits as (select distinct item_id, p, doc_id, a.i as i, d.i - a.i as diagonal from item_at a join doc_at d using (g)),
      islands as (select *, i - row_number() over (partition by item_id, p, doc_id, diagonal order by i) as island from hits),
      lengths as (select item_id, doc_id, count(*) + 39 as n from islands group by item_id, p, doc_id, diagonal, island)
      select item_id, doc_id, max(n)::int as run from lengths group by item_id, doc_id""",
    "p8_found": f"with {_SPANS_SQL} select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from held a join held b on a.g = b.g and a.doc_id < b.doc_id",
    "p8_shares": f"""with {_SPANS_SQL},
      covered as (select doc_id, sum(least(200, coalesce(after - i, 200))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as after from (select distinct doc_id, i from held)) group by doc_id),
      holders as (select g, count(distinct doc_id) as n from held group by g), most as (select doc_id, max(n) - 1 as n from held join holders using (g) group by doc_id)
      select d.doc_id, coalesce(length(text), 0)::int as n_chars, coalesce(c.n, 0)::bigint as shared_chars, case when length(text) > 0 then coalesce(c.n, 0) / length(text) else 0.0 end::double as share, coalesce(m.n, 0) as most_holders
      from documents d left join covered c on d.doc_id = c.doc_id left join most m on d.doc_id = m.doc_id""",
    "p8_removals": f"""with {_SPANS_SQL}, leads as (select g, min(doc_id) as lead from held group by g),
      cut as (select distinct doc_id, i from held join leads using (g) where lead < doc_id),
      parts as (select *, sum(case when i <= before + 200 then 0 else 1 end) over (partition by doc_id order by i) as part from (select *, coalesce(lag(i) over (partition by doc_id order by i), -1000) as before from cut))
      select doc_id, (min(i) - 1)::int as start, (max(i) + 199)::int as end from parts group by doc_id, part""",
    "p8_units": f"""with pieces as (select doc_id, generate_subscripts(l, 1) as k, unnest(l) as x from (select doc_id, regexp_split_to_array(text, '[\\n\\r\\x{{2028}}\\x{{2029}}。；！？.;!?]') as l from documents where text is not null)),
      placed as (select doc_id, x, (sum(length(x) + 1) over (partition by doc_id order by k) - length(x) - 1)::int as off from pieces),
      units as (select doc_id, {_STRIPPED} as u, off + {_LEFT} as start from placed where length({_STRIPPED}) >= {grams.LEAST_UNIT})
      select doc_id, start::int as start, (start + length(u))::int as end from (select *, row_number() over (partition by u order by doc_id, start) as n from units) where n > 1""",
}
