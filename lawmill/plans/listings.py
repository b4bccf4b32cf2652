"""Queries that list, select and prepare, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lawmill.functions import structure, titles
from lawmill.functions.text import BLANK, plain_title, stripped
from lawmill.operators import bm25 as B
from lawmill.operators import fusion, listing
from lawmill.operators.segments import ARTICLE, LINE_END
from lawmill.operators.terms import EXPANSION_WEIGHT, build_terms
from lawmill.plans.common import CLAUSES_SQL, EXPANSIONS, LAWS_SQL, clauses, latest_laws
from lawmill.plans.retrieval import _bm25_sql, _terms_sql, question_terms, ranking, searched
from lawmill.session import spread, staged, table
from lawmill.sources.embedding import embedding_text


def law_filter(spark: SparkSession, d: str) -> DataFrame:
    return listing.select_laws(latest_laws(spark, d), ("current", "historical"), "中华人民共和国保护", "条例").select("file", "title", "category", "layer")


def metadata_search(spark: SparkSession, d: str) -> DataFrame:
    return listing.metadata_search(latest_laws(spark, d), ["管理", "人民政府"]).select("file", "title", "category", "issuer")


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    laws = latest_laws(spark, d)
    by = lambda c: laws.groupBy(F.coalesce(F.trim(c), F.lit("")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("by"), "value", "n")
    return by("layer").unionByName(by("status")).unionByName(by("source"))


def manifest_order(spark: SparkSession, d: str) -> DataFrame:
    laws = latest_laws(spark, d).select("file", "category", listing.category_position(F.col("category")).alias("position"), F.coalesce("promulgated", F.lit("")).alias("promulgated"))
    return laws.orderBy("position", F.desc("promulgated"), "file")


def index_lines(spark: SparkSession, d: str) -> DataFrame:
    or_dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    link = F.when(F.col("text_status") == "full", F.concat(F.lit("[全文]("), "file", F.lit(")"))).otherwise(F.concat(F.lit("[仅元数据]("), F.coalesce("official_url", F.lit("")), F.lit(")")))
    cells = [F.coalesce("title", F.lit("")), or_dash("promulgated"), or_dash("effective"), F.coalesce("status", F.lit("")), link]
    return latest_laws(spark, d).select("category", "file", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    return embedding_text(clauses(spark, d, None))


def vectors_pending(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "build_vectors").filter("vectors is not null").select(F.col("keys").alias("key"))
    return clauses(spark, d).select("key").join(have, "key", "left_anti")


def expansions_added(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_queries")
    plain = build_terms(q, "item_id", "question").select("qid", "term", F.col("weight").alias("before"))
    full = build_terms(q, "item_id", "question", EXPANSIONS).filter("kind = 'expansion'")
    return full.join(plain, ["qid", "term"], "left").filter(F.coalesce("before", F.lit(0.0)) < EXPANSION_WEIGHT).select("qid", "term")


def term_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = searched(spark, d), staged(question_terms(spark, d), "terms")
    rows = B.df_band(B.document_frequencies(docs, terms), terms, docs.count())
    n = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("weight"), "term"))
    return rows.withColumn("n", n).filter("n <= 40").select("qid", "n", "term", "weight", "df", "used")


def search_view(spark: SparkSession, d: str) -> DataFrame:
    best = ranking(spark, d, 20).select("qid", "rank", "key")
    shown = clauses(spark, d).select("key", "title", "article", listing.clipped(F.coalesce("body", F.lit("")), 60).alias("snippet"), F.when(F.col("layer") == "current", "").otherwise("!").alias("flag"))
    return best.join(shown, "key").select("qid", "rank", "title", "article", "snippet", "flag")


def document_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), LINE_END)
    t = spread(table(spark, d, "documents").select("doc_id", lines.alias("l")))
    return t.select("doc_id", F.size(F.filter("l", lambda x: x.rlike(ARTICLE))).alias("articles"), F.size(F.filter("l", lambda x: F.startswith(x, F.lit("## ")))).alias("headings"),
                    F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


def structure_heads(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), LINE_END), lambda x: stripped(F.regexp_replace(x, "^#+ ", "")))
    t = spread(table(spark, d, "documents").select("doc_id", "title", F.filter(lines, lambda x: x != "").alias("paras")))
    return structure.document_heads(t, "paras", "title").select("doc_id", "head.title", "head.history", "head.article_count", "head.chapter_count")


def title_flags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "check_updates").select(plain_title(F.col("title")).alias("title")).filter("title is not null").distinct()
    return t.select("title", F.col("title").rlike(titles.DECISION).alias("decision"), F.col("title").rlike(titles.VOID).alias("void"), F.col("title").rlike("修正文本|修正案").alias("amended"), F.col("title").rlike("(?:条例|办法|规定|细则)$").alias("instrument"))


def download_queue(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "fetch_local_meta").filter("bbbs is not null").select("bbbs", "category", F.coalesce("promulgated", F.lit("")).alias("promulgated")).distinct()
    done = table(spark, d, "fetch_local_meta").filter("status_code = 1").select("bbbs")
    return t.join(done, "bbbs", "left_anti").orderBy("category", "promulgated", "bbbs")


def cache_fresh(spark: SparkSession, d: str) -> DataFrame:
    return listing.fresh(table(spark, d, "fetch_local_meta"), "fetched_at", F.to_timestamp(F.lit("2026-02-09 00:30:00")), 7).select("bbbs").distinct()


def merged_parts(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("article", r"[\s\p{Z}]", "")
    return listing.merged_parts(clauses(spark, d, None).withColumn("part", plain), "file", "part", "body", ["第一条", "第二条", "第三条"])


def supplement_match(spark: SparkSession, d: str) -> DataFrame:
    han = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^一-鿿]", "")
    sources = table(spark, d, "check_updates").select(han(F.col("title")).alias("key"), F.coalesce(plain_title(F.col("title")), F.lit("")).alias("path")).distinct()
    return listing.supplement(table(spark, d, "fetch_local_meta").select(han(F.col("title")).alias("key")), sources)


def rewrite_lists(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.coalesce("question", F.lit("")), F.coalesce("note", F.lit(""))
    answer = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json(F.array(q, n)), F.lit("\n```"))).otherwise(F.concat(F.lit("1. "), q, F.lit("；- "), n))
    return table(spark, d, "eval_queries").select("item_id", F.posexplode(listing.rewrite_list(answer, 3)).alias("i", "text"))


def rrf_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """The question and each of its rewrites as routes, counted in one pass and fused."""
    routes = rewrite_lists(spark, d).select(F.concat_ws("#", "item_id", "i").alias("id"), "text")
    main = table(spark, d, "eval_queries").select(F.concat_ws("#", "item_id", F.lit("q")).alias("id"), F.col("question").alias("text"))
    terms = build_terms(main.unionByName(routes), "id", "text", EXPANSIONS)
    part = F.split("qid", "#")
    terms = staged(terms.select(part[1].alias("route"), part[0].cast("long").alias("qid"), "term", "weight", "kind", "min_df"), "terms")
    lists = B.ranked(B.bm25(searched(spark, d), terms, ("qid", "route")), 100, ("qid", "route"))
    return fusion.top(fusion.multi_route([lists]), "rrf", 20).select("qid", "rank", "key", "rrf")


QUERIES = {f.__name__: f for f in (
    law_filter, metadata_search, manifest_counts, manifest_order, index_lines, embedding_input, vectors_pending, expansions_added, term_diagnostics, search_view, document_counts, structure_heads,
    title_flags, download_queue, cache_fresh, merged_parts, supplement_match, rewrite_lists, rrf_rewrites,
)}

_ORDER = "case category " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(listing.CATEGORY_ORDER)) + f" else {listing.LAST} end"
_PLAIN = r"nullif(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '[\s\x{1c}-\x{1f}\x{85}\pZ]+', '', 'g'), '')"
_HAN = r"regexp_replace(coalesce(title, ''), '[^\x{4e00}-\x{9fff}]', '', 'g')"
_PARTS = ["第一条", "第二条", "第三条"]

_trim = lambda c: rf"regexp_replace({c}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+$', '', 'g')"
_tight = lambda c: rf"regexp_replace({c}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', '', 'g')"
_S = structure


def _re(pattern: str) -> str:
    """A pattern of Spark as DuckDB reads it."""
    return pattern.replace(BLANK, r"\s\x{1c}-\x{1f}\x{85}\pZ")


def _heads_sql() -> str:
    has = lambda x, p: f"regexp_matches({x}, '{_re(p)}')"
    is_title = lambda x: f"regexp_matches({x}, '{_re(_S.TITLED)}')"
    head = f"""case when {is_title('x')} and not coalesce({is_title('before')}, false) then 't' when {has('x', _S.NOTE)} and not {has('x', _S.LIST_MARK)} then 'b' when {has('x', _S.NUMBER)} then 'n'
      when {has('x', '|'.join(_S.MASTHEAD))} or (whole <> '' and {_tight('x')} = whole) then 'm' else 'x' end"""
    body = f"""case when {has('x', _S.CONTENTS)} then 'c' when {has('x', _S.HEADING)} then 'h' when {has('x', _S.ARTICLE)} then 'a' when {_tight('x')} in ({', '.join(f"'{p}'" for p in _S.PREFACES)}) then 'f'
      when x <> '' and length(x) <= {_S.SHORT_ENTRY} then 's' else 'p' end"""
    return rf"""with raw as (select doc_id, {_tight("coalesce(title, '')")} as whole, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
        lambda x: {_trim("regexp_replace(x, '^#+ ', '')")}), lambda x: x <> '') as p from documents),
      lines as (select doc_id, whole, generate_subscripts(p, 1) as i, unnest(p) as x from raw),
      seen as (select *, lag(x) over (partition by doc_id order by i) as before, string_agg({_tight('x')}, '') over (partition by doc_id order by i rows unbounded preceding) as so_far from lines),
      letters as (select doc_id, i, x, {head} as h, {has('x', _S.CLOSED)} as closed, {body} as b, starts_with(whole, so_far) as goes_on from seen),
      words as (select doc_id, string_agg(case when closed then upper(h) else h end, '' order by i) as head, string_agg(b, '' order by i) as body, list(x order by i) as p,
                       coalesce(min(i) filter (i > 1 and not goes_on), 1000000000) as stops, count(*) as n from letters group by doc_id),
      a as (select *, case when stops = 2 or n < 2 then 1 else least(stops - 1, {_S.TITLE_LINES}, n) end::int as used from words),
      c as (select *, strpos(substr(left(body, {_S.CONTENTS_WITHIN}), used + 1), 'c') as mark from a),
      z as (select *, case when mark > 0 then substr(head, used + 1, mark - 1) else regexp_extract(substr(head, used + 1, {_S.HEAD_LINES}), '^{_S.HEAD}') end as zone from c),
      o as (select *, used + length(zone) + case when mark > 0 then 1 else 0 end as first, strpos(zone, nullif(regexp_extract(zone, '{_S.NOTES}'), '')) as note_at, length(regexp_extract(zone, '{_S.NOTES}')) as note from z),
      r as (select *, substr(body, first + 1) as rest, length(case when mark > 0 then regexp_extract(substr(body, first + 1), '{_S.ENTRIES}') when regexp_matches(substr(body, first + 1), '^h{{{_S.BARE_CONTENTS}}}') then regexp_extract(substr(body, first + 1), '{_S.BARE_ENTRIES}') else '' end) as run from o),
      e as (select *, first + nullif(strpos(left(rest, run), 'h'), 0) as entry from r),
      f as (select *, entry + nullif(list_position(list_transform(p[entry + 1:], lambda x: {_tight('x')}), {_tight('p[entry]')}), 0) as again from e),
      g as (select *, greatest(1, case when mark > 0 or run > 0 then least(first + run, coalesce(again - 1, 1000000000), coalesce(first + nullif(strpos(rest, 'a'), 0) - 1, 1000000000)) else first end) as begin from f)
      select d.doc_id, coalesce(p[1], '') as title, coalesce(case when note_at > 0 then array_to_string(list_transform(p[used + note_at:used + note_at + note - 1], lambda x: {_trim('x')}), ' ') end, '') as history,
             coalesce(length(regexp_replace(substr(body, begin + 1), '[^a]', '', 'g')), 0)::int as article_count, coalesce(length(regexp_replace(substr(body, begin + 1), '[^h]', '', 'g')), 0)::int as chapter_count
      from documents d left join g on d.doc_id = g.doc_id"""


_REWRITES = r"""a as (select item_id, case when item_id % 2 = 0 then [trim(coalesce(question, ''), ' '), trim(coalesce(note, ''), ' ')]
        else list_transform(list_filter(regexp_split_to_array('1. ' || coalesce(question, '') || '；- ' || coalesce(note, ''), '[\n；;]+'), lambda x: trim(x, ' ') <> ''),
                            lambda x: regexp_replace(regexp_replace(x, '^[ \t\-"''、,，0-9.）)]+', ''), '[ \t\-"''、,，0-9.）)]+$', '')) end as l from eval_queries),
      b as (select item_id, case when item_id % 2 = 0 then list_filter(l, lambda x: x <> '') else l end[:3] as l from a)"""


def _rewrite_route(route: str) -> str:
    words = _bm25_sql("t").replace("eval_queries", "one_route")
    return f"select qid, key, rank from (with one_route as (select item_id, t from asked where route = '{route}'), {words} select qid, key, rank from words where rank <= 100)"


SQL = {
    "structure_heads": _heads_sql(),
    "law_filter": f"with {LAWS_SQL} select file, title, category, layer from laws where coalesce(trim(layer, ' '), 'current') in ('current', 'historical') and contains(title, '保护') and contains(category, '条例')",
    "metadata_search": f"with {LAWS_SQL} select file, title, category, issuer from laws where contains(concat_ws(' ', coalesce(title, ''), coalesce(category, ''), coalesce(issuer, '')), '管理') and contains(concat_ws(' ', coalesce(title, ''), coalesce(category, ''), coalesce(issuer, '')), '人民政府')",
    "manifest_counts": f"with {LAWS_SQL} " + " union all ".join(f"select '{c}' as by, coalesce(trim({c}, ' '), '') as value, count(*) as n from laws group by 2" for c in ("layer", "status", "source")),
    "manifest_order": f"with {LAWS_SQL} select file, category, {_ORDER} as position, coalesce(promulgated, '') as promulgated from laws",
    "index_lines": f"""with {LAWS_SQL} select category, file, '| ' || concat_ws(' | ', coalesce(title, ''), coalesce(nullif(promulgated, ''), '—'), coalesce(nullif(effective, ''), '—'), coalesce(status, ''),
      case when text_status = 'full' then '[全文](' || file || ')' else '[仅元数据](' || coalesce(official_url, '') || ')' end) || ' |' as line from laws""",
    "embedding_input": f"with {CLAUSES_SQL} select key, trim(concat_ws(' ', coalesce(title, ''), coalesce(article, ''), coalesce(chapter, ''), coalesce(body, '')), ' ') as text from all_clauses",
    "vectors_pending": f"with {CLAUSES_SQL} select key from clauses where key not in (select keys from build_vectors where vectors is not null and keys is not null)",
    "expansions_added": f"""with {_terms_sql()}, plain as (select qid, term, max(weight) as before from raw_terms where kind <> 'expansion' group by all)
      select distinct r.qid, r.term from raw_terms r left join plain p on r.qid = p.qid and r.term = p.term where r.kind = 'expansion' and coalesce(before, 0) < {EXPANSION_WEIGHT}""",
    "term_diagnostics": f"with {_bm25_sql()} select * from (select qid, row_number() over (partition by qid order by weight desc, term) as n, term, weight, df, used from band) where n <= 40",
    "search_view": f"""with {_bm25_sql()} select qid, rank, c.title, c.article, case when length(coalesce(c.body, '')) > 60 then left(c.body, 60) || '…' else coalesce(c.body, '') end as snippet, case when c.layer = 'current' then '' else '!' end as flag
      from words w join clauses c on w.key = c.key where rank <= 20""",
    "document_counts": r"""with l as (select doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') as l from documents)
      select doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^第[零一二三四五六七八九十百千万两]+[\s\x{1c}-\x{1f}\x{85}\pZ]*条')))::int as articles, len(list_filter(l, lambda x: starts_with(x, '## ')))::int as headings,
             coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::int as chars from l""",
    "title_flags": f"select title, regexp_matches(title, '{titles.DECISION}') as decision, regexp_matches(title, '{titles.VOID}') as void, regexp_matches(title, '修正文本|修正案') as amended, regexp_matches(title, '(?:条例|办法|规定|细则)$') as instrument from (select distinct {_PLAIN} as title from check_updates) where title is not null",
    "download_queue": "select distinct bbbs, category, coalesce(promulgated, '') as promulgated from fetch_local_meta where bbbs is not null and bbbs not in (select bbbs from fetch_local_meta where status_code = 1 and bbbs is not null)",
    "cache_fresh": "select distinct bbbs from fetch_local_meta where epoch_us(fetched_at) >= epoch_us(timestamp '2026-02-09 00:30:00') - 7 * 86400000000",
    "merged_parts": f"""with {CLAUSES_SQL}, p as (select file, {', '.join(f"min(case when regexp_replace(article, '[{chr(92)}s{chr(92)}pZ]', '', 'g') = '{x}' then body end) as p{i}" for i, x in enumerate(_PARTS))} from all_clauses group by file)
      select file, concat_ws(chr(10) || chr(10), {', '.join(f"'## {x}' || chr(10) || chr(10) || p{i}" for i, x in enumerate(_PARTS))}) as text from p where p0 is not null and p1 is not null and p2 is not null""",
    "supplement_match": f"""with s as (select key, min(path) as path from (select {_HAN} as key, coalesce({_PLAIN}, '') as path from check_updates) where key <> '' group by key),
      w as (select distinct {_HAN} as key from fetch_local_meta where {_HAN} <> '')
      select w.key, s.path, 'exact' as how from w join s on w.key = s.key union all
      select w.key, min(s.path), 'held' from w, s where w.key not in (select key from s) and (contains(w.key, s.key) or contains(s.key, w.key)) group by w.key""",
    "rewrite_lists": f"with {_REWRITES} select item_id, (generate_subscripts(l, 1) - 1)::int as i, unnest(l) as text from b",
    "rrf_rewrites": f"""with {_REWRITES}, rewritten as (select item_id, (generate_subscripts(l, 1) - 1)::int as i, unnest(l) as text from b),
      asked as (select item_id, 'q' as route, question as t from eval_queries union all select item_id, i::varchar, text from rewritten)
      select * from (select qid, row_number() over (partition by qid order by rrf desc, key) as rank, key, rrf from (
        select qid, key, round(sum(1.0::double / (60 + rank)), 9) as rrf from ({' union all '.join(_rewrite_route(r) for r in ('q', '0', '1', '2'))}) group by qid, key)) where rank <= 20""",
}
