"""Queries of retrieval, segmentation, keyword search and evaluation, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.functions.numerals import article_label
from lawmill.operators import bm25 as B
from lawmill.operators import evaluation as E
from lawmill.operators import fusion, segments
from lawmill.operators.terms import EXPANSION_WEIGHT, GRAMS, LONGEST_PHRASE, SEPARATOR, STOP_CHARS, build_terms
from lawmill.plans.common import CLAUSES_SQL, EXPANSIONS, clauses, searched
from lawmill.session import spread, staged, table

DIM = 64


def question_terms(spark: SparkSession, d: str, text: str = "question") -> DataFrame:
    return build_terms(table(spark, d, "eval_queries"), "item_id", text, EXPANSIONS)


def term_build(spark: SparkSession, d: str) -> DataFrame:
    return question_terms(spark, d).select("qid", "term", "weight", "kind", "min_df")


def df_band(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = searched(spark, d), staged(question_terms(spark, d), "terms")
    return B.df_band(B.document_frequencies(docs, terms), terms, docs.count()).select("qid", "term", "df", "used")


def word_scores(spark: SparkSession, d: str) -> DataFrame:
    return B.bm25(searched(spark, d), staged(question_terms(spark, d), "terms"))


def ranking(spark: SparkSession, d: str, depth: int) -> DataFrame:
    return B.ranked(word_scores(spark, d), depth)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d, 20).select("qid", "rank", "key", "score")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return fusion.usable_vectors(table(spark, d, "build_vectors"), "keys", "vectors", DIM)


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Precomputed query vectors stand in for an embedding service: vec_id is the question's id."""
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vec"))
    return q.join(table(spark, d, "eval_queries").select(F.col("item_id").alias("qid")).distinct(), "qid", "left_semi")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vec"))
    return fusion.vector_search(q, _vectors(spark, d), DIM, 20)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    scores = staged(word_scores(spark, d), "scores")
    vectors = staged(fusion.vector_search(_query_vectors(spark, d), _vectors(spark, d), DIM, fusion.CANDIDATES), "near")
    # a key that only the words hold comes among the first 20 only if its word rank does
    first = B.ranked(scores, 20).select("qid", "key", "rank", "score")
    words = B.ranks_of(scores, vectors).unionByName(first.join(vectors, ["qid", "key"], "left_anti"))
    return fusion.top(fusion.hybrid(words, vectors), "rrf", 20).select("qid", "rank", "key", "bm25", "cosine", "rrf")


ROUTES = ("question", "passage", "note")


def rrf_multiroute(spark: SparkSession, d: str) -> DataFrame:
    terms = [question_terms(spark, d, c).withColumn("route", F.lit(c)) for c in ROUTES]
    every = staged(terms[0].unionByName(terms[1]).unionByName(terms[2]), "terms")
    lists = B.ranked(B.bm25(searched(spark, d), every, ("qid", "route")), 100, ("qid", "route"))
    return fusion.top(fusion.multi_route([lists]), "rrf", 20).select("qid", "rank", "key", "rrf")


POOL = 20


def _segment_scores(spark: SparkSession, d: str, original: DataFrame) -> DataFrame:
    head = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("article", F.lit("")))
    questions = table(spark, d, "eval_queries").select(F.col("item_id").alias("qid"), F.coalesce("question", F.lit("")).alias("text"))
    parts = segments.paragraphs(F.col("body"), head, segments.MOST_SEGMENTS)
    hits = fusion.segment_scores(original.filter(F.col("rank") <= POOL), questions, clauses(spark, d), parts, lambda c: fusion.char_histogram(c, DIM))
    return fusion.best_segment(hits, "key", POOL)


def segment_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _segment_scores(spark, d, ranking(spark, d, POOL)).select("qid", "key", "rank", "score")


def rerank_fusion(spark: SparkSession, d: str) -> DataFrame:
    original = staged(ranking(spark, d, 2 * POOL).select("qid", "key", "rank"), "original")
    return fusion.rerank_head(original, _segment_scores(spark, d, original), POOL, "fuse").select("qid", "key", "rank")


def segment_lines(spark: SparkSession, d: str) -> DataFrame:
    return segments.clauses(spread(table(spark, d, "documents").select("doc_id", "text")), "text").select("doc_id", "article", "chapter", "body", "line")


def clause_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("article", F.lit("")))
    return clauses(spark, d, None).select("key", F.posexplode(segments.paragraphs(F.col("body"), head)).alias("n", "segment"))


def _hits(spark: SparkSession, d: str, terms: list[str], any_term: bool) -> DataFrame:
    return segments.hits_per_text(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", terms, any_term)


def keyword_all(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, ["备案", "限值"], False)


def keyword_any(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, ["食品", "燃气"], True)


def hits_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return keyword_any(spark, d).groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("line").alias("first_line"))


def article_lookup(spark: SparkSession, d: str) -> DataFrame:
    same = F.regexp_replace(F.regexp_replace("article", r"[\s\p{Z}]", ""), "^第(\\d+)条$", "$1")
    return clauses(spark, d).filter(article_label(same) == "第八条").select("title", "file", "line", "article")


def article_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return segments.article_blocks(docs, "doc_id", "text", article_label(F.lit("8")), ["应当"])


def layer_filter(spark: SparkSession, d: str) -> DataFrame:
    return clauses(spark, d, ("current", "historical")).groupBy("layer", "category").agg(F.count("*").alias("clauses"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    results = ranking(spark, d, max(E.KS)).withColumnRenamed("title", "law")
    q = table(spark, d, "eval_queries").select(F.col("item_id").alias("qid"), "kind", "must_include", "acceptable")
    return E.answer_positions(results, q)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return E.rates_at_k(_positions(spark, d))


def mrr(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_reciprocal_rank(_positions(spark, d))


def hits_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return E.hits_by_kind(_positions(spark, d))


def hit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.hit_histogram(_positions(spark, d))


def unknown_answers(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_queries").select(F.col("item_id").alias("qid"), "must_include")
    return E.unknown_answers(q, clauses(spark, d).select(F.col("title").alias("law"), "article"))


# SQL -----------------------------------------------------------------------------------------------------------------

_EXP = ", ".join(f"('{k}', '{v}')" for k, vs in EXPANSIONS.items() if k[0] != "_" for v in vs)
_SEP = SEPARATOR.replace("一-鿿", r"\x{4e00}-\x{9fff}")


def _terms_sql(text: str = "question") -> str:
    return f"""
segs as (select qid, s from (select item_id as qid, unnest(regexp_split_to_array(coalesce({text}, ''), '{_SEP}')) as s from eval_queries) where s <> ''),
sized as (select * from (values {', '.join(f'({n}, {w}, {m})' for n, (w, m) in GRAMS.items())}) v(n, w, m)),
grams as (select qid, substr(s, i, n) as term, w as weight, 'gram' as kind, m as min_df
          from (select qid, s, n, w, m, unnest(range(1, length(s) - n + 2)) as i from segs, sized where length(s) >= n)),
joined as (select item_id as qid, regexp_replace(coalesce({text}, ''), '{_SEP}', '', 'g') as j from eval_queries),
raw_terms as (
  select qid, s as term, 1.0 as weight, 'phrase' as kind, 1 as min_df from segs where length(s) <= {LONGEST_PHRASE}
  union all select * from grams where not regexp_matches(term, '[{STOP_CHARS}]')
  union all select qid, v, {EXPANSION_WEIGHT}, 'expansion', 1 from joined, (values {_EXP}) e(k, v) where contains(j, k)),
terms as (select qid, term, weight::double as weight, kind, min_df from (
  select *, row_number() over (partition by qid, term order by weight desc, kind desc, min_df desc) as rn from raw_terms) where rn = 1)"""


def _bm25_sql(text: str = "question") -> str:
    return f"""{CLAUSES_SQL}, {_terms_sql(text)},
docs as (select key, title, article, coalesce(title, '') as t, coalesce(body, '') as body, length(coalesce(body, '')) as n_chars from clauses),
n as (select count(*) as n, avg(n_chars) as average from docs),
tf as (select key, term, (length(body) - length(replace(body, term, ''))) // length(term) as tf, contains(t, term) as in_title, n_chars
       from docs join (select distinct term from terms) x on contains(docs.body, x.term)),
dfs as (select term, count(*) as df from tf group by term),
band as (
  select qid, t.term, weight, coalesce(df, 0) as df, n.n, n.average,
         coalesce(df, 0) >= least(case when kind = 'gram' then min_df else 1 end, greatest(1, floor({B.DF_FLOOR_SHARE} * n.n)::int))
         and coalesce(df, 0) <= greatest({B.DF_CEILING} * n.n * case when kind = 'phrase' then 0.5 else 1.0 end, {B.DF_CEILING_LEAST}) as used
  from terms t left join dfs on t.term = dfs.term, n),
scores as (
  select qid, key, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {B.K1 + 1} / (tf + {B.K1} * ({1 - B.B} + {B.B} * n_chars / average)) + case when in_title then {B.TITLE_BONUS} else 0.0 end)), 6) as score
  from band join tf on band.term = tf.term where used and df > 0 group by qid, key),
words as (select qid, row_number() over (partition by qid order by score desc, d.title nulls first, d.article nulls first, d.key) as rank, s.key, score, d.title as law, d.article
          from scores s join docs d on s.key = d.key)"""


_VECTORS = f"""
index_vectors as (select keys as key, min(vectors::double[]) as vec from build_vectors
                  where keys is not null and len(vectors) = {DIM} and len(list_filter(vectors, lambda x: x <> 0)) > 0 group by keys),
hits as (select *, row_number() over (partition by qid order by score desc, key) as rank from (
  select q.qid, i.key, round(list_cosine_similarity(q.vec, i.vec), 6) as score from query_vectors q, index_vectors i))"""
_QUESTION_VECTORS = "query_vectors as (select vec_id as qid, embedding::double[] as vec from embeddings where vec_id in (select item_id from eval_queries))"

_LINES = r"""
lines as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as x from (
  select doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') as l from documents))"""
_BL = r"[\s\x{1c}-\x{1f}\x{85}\pZ]"
_NB = r"[^\s\x{1c}-\x{1f}\x{85}\pZ]"
_NUM = segments.NUMBER
_STRIP = rf"regexp_replace(x, '^{_BL}+|{_BL}+$', '', 'g')"


def _marks_sql() -> str:
    head = rf"regexp_extract(x, '^#{{2,3}}{_BL}*(.+?){_BL}*$', 1)"
    return rf"""{_LINES},
marks as (select *, {_STRIP} as s,
  case when regexp_matches(x, '^#{{2,3}}{_BL}*(.+?){_BL}*$') then {head} end as h, regexp_matches(x, '^第{_NUM}+{_BL}*条') as is_article from lines),
kinds as (select *, case when h is not null then case when regexp_matches(h, '^第{_NUM}+{_BL}*[章节]') then 'c' when regexp_matches(h, '^第{_NUM}+{_BL}*(?:分编|[编篇])') then 'b' else 'o' end when is_article then 'a' end as k from marks),
state as (select *, sum(case when k is not null then 1 else 0 end) over w as unit,
  last_value(case when k in ('b', 'o') then h end ignore nulls) over w as book,
  max(case when k = 'b' then i end) over w as book_at, max(case when k = 'c' then i end) over w as chapter_at,
  last_value(case when k = 'c' then h end ignore nulls) over w as last_chapter
  from kinds window w as (partition by doc_id order by i rows unbounded preceding))"""


def _hits_sql(terms: list[str], any_term: bool) -> str:
    held = " + ".join(f"contains({{}}, '{t}')::int" for t in terms)
    n_line, n_text = held.replace("{}", "x"), held.replace("{}", "shown")
    return rf"""{_marks_sql()},
texts as (select doc_id, string_agg(x, chr(10) order by i) as shown from lines where not starts_with(ltrim(x, ' '), '> ') group by doc_id),
good as (select doc_id from texts where {n_text} {'> 0' if any_term else f'= {len(terms)}'}),
labelled as (select doc_id, i, x, s, {n_line} as n, last_value(case when is_article then regexp_extract(x, '^{_BL}*({_NB}+)', 1)
  when starts_with(x, '## ') then regexp_replace(regexp_replace(x, '^[# ]+', ''), '^{_BL}+|{_BL}+$', '', 'g') end ignore nulls) over (partition by doc_id order by i rows unbounded preceding) as label from marks),
found as (select l.doc_id, i::int as line, case when length(s) > 120 then s[:120] || '…' else s end as text, coalesce(label, '') as label,
  row_number() over (partition by l.doc_id order by n desc, i) as rn from labelled l join good g on l.doc_id = g.doc_id where n > 0)"""


_POSITIONS = f"""with {_bm25_sql()},
best as (select qid, law, article, min(rank) as rank from words where rank <= {max(E.KS)} group by all),
wanted as (select item_id as qid, u.law, u.article, true as must from (select item_id, unnest(must_include) as u from eval_queries)
           union all select item_id, u.law, u.article, false from (select item_id, unnest(acceptable) as u from eval_queries)),
found as (select w.qid, count(*) filter (must) as must, list(rank) filter (must and rank is not null) as positions,
                 coalesce(min(rank) filter (must), min(rank) filter (not must)) as first
          from wanted w left join best b on w.qid = b.qid and w.law = b.law and w.article = b.article group by w.qid having count(*) filter (must) > 0)
"""
_KS = "(values " + ", ".join(f"({k})" for k in E.KS) + ") ks(k)"

QUERIES = {f.__name__: f for f in (
    term_build, df_band, bm25_topk, vector_topk, rrf_hybrid, rrf_multiroute, segment_rerank, rerank_fusion, segment_lines, clause_paragraphs, keyword_all, keyword_any,
    hits_per_doc, article_lookup, article_blocks, layer_filter, recall_at_k, mrr, hits_by_kind, hit_histogram, unknown_answers,
)}


def _route(text: str) -> str:
    return f"select qid, key, rank from (with {_bm25_sql(text)} select qid, key, rank from words where rank <= 100)"


def _parts_sql(most: int | None, source: str) -> str:
    """key, n, segment of the paragraphs of clauses."""
    first = f"[:{most}]" if most else ""
    return rf"""
      l as (select key, concat_ws(' ', coalesce(title, ''), coalesce(article, '')) as head, list_filter(list_transform(regexp_split_to_array(coalesce(body, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
              lambda x: {_STRIP}), lambda x: x <> '' and not starts_with(x, '#')) as l from {source}),
      p as (select key, head, list_filter(string_split(array_to_string(list_transform(l, lambda x, i: case when i = 1 then x when regexp_matches(x, '{segments.ITEM}') then ' ' || x else chr(10) || x end), ''), chr(10)), lambda x: x <> '') as p from l),
      parts as (select key, case when len(p) > 1 then list_transform(p{first}, lambda x, i: head || ' 第' || i || '款 ' || x) when len(p) = 1 then [head || ' ' || p[1]] else [head] end as s from p),
      pieces as (select key, (generate_subscripts(s, 1) - 1)::int as n, unnest(s) as segment from parts)"""


def _segments_sql() -> str:
    vector = lambda c: f"list_transform(range({DIM}), lambda d: len(list_filter(list_transform(string_split({c}, ''), lambda x: unicode(x) % {DIM}), lambda r: r = d))::double)"
    return f"""pool as (select qid, key from words where rank <= {POOL}), pooled as (select * from clauses where key in (select key from pool)), {_parts_sql(segments.MOST_SEGMENTS, 'pooled')},
      embedded as (select key, {vector('segment')} as v from pieces), asked as (select item_id as qid, {vector("coalesce(question, '')")} as q from eval_queries),
      best as (select p.qid, p.key, max(round(list_cosine_similarity(q, v), 6)) as score from pool p join asked a on p.qid = a.qid join embedded e on p.key = e.key group by all),
      reranked as (select qid, key, row_number() over (partition by qid order by score desc, key) as rank, score from best)"""


SQL = {
    "term_build": f"with {_terms_sql()} select qid, term, weight, kind, min_df from terms",
    "df_band": f"with {_bm25_sql()} select qid, term, df, used from band",
    "bm25_topk": f"with {_bm25_sql()} select qid, rank, key, score from words where rank <= 20",
    "vector_topk": f"with query_vectors as (select vec_id as qid, embedding::double[] as vec from embeddings where vec_id % 50 = 0), {_VECTORS} select qid, key, rank, score from hits where rank <= 20",
    "rrf_hybrid": f"""with {_bm25_sql()}, {_QUESTION_VECTORS}, {_VECTORS},
      near as (select * from hits where rank <= {fusion.CANDIDATES}),
      fused as (select coalesce(w.qid, v.qid) as qid, coalesce(w.key, v.key) as key, w.score as bm25, v.score as cosine,
                       round(coalesce(1.0::double / ({fusion.RRF_K} + w.rank), 0) + coalesce(1.0::double / ({fusion.RRF_K} + v.rank), 0), 9) as rrf
                from words w full outer join near v on w.qid = v.qid and w.key = v.key)
      select * from (select qid, row_number() over (partition by qid order by rrf desc, key) as rank, key, bm25, cosine, rrf from fused) where rank <= 20""",
    "rrf_multiroute": f"""select * from (select qid, row_number() over (partition by qid order by rrf desc, key) as rank, key, rrf from (
      select qid, key, round(sum(1.0::double / ({fusion.RRF_K} + rank)), 9) as rrf from ({' union all '.join(_route(c) for c in ('question', 'passage', 'note'))}) group by qid, key)) where rank <= 20""",
    "segment_rerank": f"""with {_bm25_sql()}, {_segments_sql()} select qid, key, rank, score from reranked""",
    "rerank_fusion": f"""with {_bm25_sql()}, {_segments_sql()},
      head as (select w.qid, w.key, w.rank, row_number() over (partition by w.qid order by r.score desc nulls last, w.rank) as new from words w left join reranked r on w.qid = r.qid and w.key = r.key where w.rank <= {POOL})
      select qid, key, row_number() over (partition by qid order by round(-(1.0::double / (60 + rank) + 1.0::double / (60 + new)), 12), rank) as rank from head
      union all select qid, key, rank from words where rank > {POOL} and rank <= {2 * POOL}""",
    "segment_lines": rf"""with {_marks_sql()},
      units as (select doc_id, unit, string_agg(case when s <> '' then s end, ' ' order by i) as body from state group by all)
      select st.doc_id, regexp_extract(x, '^{_BL}*({_NB}+)', 1) as article,
             trim(coalesce(book, '') || ' ' || case when chapter_at is not null and chapter_at > coalesce(book_at, -1) then last_chapter else '' end) as chapter, u.body, i::int as line
      from state st join units u on st.doc_id = u.doc_id and st.unit = u.unit where st.k = 'a'""",
    "keyword_all": f"with {_hits_sql(['备案', '限值'], False)} select doc_id, line, text, label from found where rn <= 3",
    "keyword_any": f"with {_hits_sql(['食品', '燃气'], True)} select doc_id, line, text, label from found where rn <= 3",
    "hits_per_doc": f"with {_hits_sql(['食品', '燃气'], True)} select doc_id, count(*) as hits, min(line) as first_line from found where rn <= 3 group by doc_id",
    "article_lookup": rf"with {CLAUSES_SQL} select title, file, line, article from clauses where regexp_replace(article, '[\s\pZ]', '', 'g') in ('第八条', '第8条', '8', '八', '8条', '八条')",
    "article_blocks": rf"""with {_LINES}, starts as (select doc_id, min(i) as first from lines where starts_with(x, '第八条') group by doc_id),
      ends as (select s.doc_id, first, coalesce(min(l.i), 1000000000) as last from starts s left join lines l on s.doc_id = l.doc_id and l.i > first and regexp_matches(x, '^第{_NUM}+{_BL}*条') group by all),
      blocks as (select e.doc_id, first::int as line, string_agg(x, chr(10) order by i) as x from ends e join lines l on e.doc_id = l.doc_id and i >= first and i < last group by all)
      select doc_id, line, {_STRIP} as block from blocks where contains(x, '应当')""",
    "layer_filter": f"with {CLAUSES_SQL} select layer, category, count(*) as clauses, sum(length(coalesce(body, ''))) as chars from all_clauses where coalesce(layer, 'current') in ('current', 'historical') group by all",
    "recall_at_k": _POSITIONS + f"""select k, round(sum(len(list_filter(coalesce(positions, []), lambda p: p <= k))) / sum(must), 6) as recall,
      round(avg((coalesce(first, 1000000000) <= k)::int), 6) as hit, round(avg((len(coalesce(positions, [])) = must and list_max(positions) <= k)::int), 6) as all_hit from found, {_KS} group by k""",
    "mrr": _POSITIONS + "select cut, round(avg(case when first <= cut then 1.0::double / first else 0 end), 6) as mrr from found, (values (8), (20)) c(cut) group by cut",
    "hits_by_kind": _POSITIONS + "select kind, count(*) as questions, sum((coalesce(first, 1000000000) <= 8)::bigint)::bigint as hits from found join eval_queries q on found.qid = q.item_id group by kind",
    "hit_histogram": _POSITIONS + "select first, count(*) as questions from found group by first",
    "unknown_answers": f"with {CLAUSES_SQL} select qid, u.law as law, u.article as article from (select item_id as qid, unnest(must_include) as u from eval_queries) w where not exists (select 1 from clauses c where c.title = w.u.law and c.article = w.u.article)",
    "clause_paragraphs": f"with {CLAUSES_SQL}, {_parts_sql(None, 'all_clauses')} select key, n, segment from pieces",
}
