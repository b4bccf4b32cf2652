"""Queries on catalogs, versions, audits and the scalar functions, with their SQL counterparts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.functions import numerals, titles
from lawmill.functions.hashing import clause_json, digest
from lawmill.functions.text import iso_date, plain_title, stripped
from lawmill.operators import audit, build, catalog, listing
from lawmill.operators.segments import LINE_END
from lawmill.plans.common import CLAUSES_SQL, EXPANSIONS, LAWS_SQL, clauses, latest_laws
from lawmill.plans.retrieval import _bm25_sql, word_scores
from lawmill.plans.tracking import _sql_day
from lawmill.session import spread, staged, table

TODAY = "2026-06-30"


def _name(c: str = "file") -> dict:
    return titles.split_name(F.col(c))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    n = _name()
    return latest_laws(spark, d).select("file", n["title"].alias("title"), n["date"].alias("date"), n["voided"].alias("voided"))


def safe_stems(spark: SparkSession, d: str) -> DataFrame:
    laws = latest_laws(spark, d)
    long_title = F.concat(F.coalesce("title", F.lit("")), F.repeat(F.coalesce("issuer", F.lit("某")), F.lit(8)))
    stem = titles.safe_stem(long_title, F.col("promulgated"), F.coalesce("category", F.lit("未分类")))
    named = catalog.numbered_names(laws.select("file", F.coalesce("title", F.lit("")).alias("title"), stem.alias("stem")), "title", "file")
    return named.select("file", "stem", F.octet_length("stem").alias("bytes"), "unique_name")


def _official(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of the catalog: one row per title and date; a void mark is no part of a title, as in file names."""
    t = table(spark, d, "check_updates")
    last = t.agg(F.max("snapshot").alias("s"))
    rows = t.join(F.broadcast(last), t["snapshot"] == last["s"])  # one row
    title = F.nullif(F.regexp_replace(plain_title(F.col("title")), titles.VOID, ""), F.lit(""))
    rows = rows.select(title.alias("title"), iso_date(F.col("promulgated")).alias("date"), iso_date(F.col("effective")).alias("effective"), "status", "status_code", "category", "issuer", "received_at")
    return rows.filter("title is not null").groupBy("title", "date").agg(
        F.max_by(F.struct("effective", "status", "status_code", "category", "issuer"), F.struct("received_at", "effective", F.coalesce("status_code", F.lit(-99)))).alias("m")
    ).select("title", F.nullif("date", F.lit("")).alias("date"), "m.*")


def catalog_match(spark: SparkSession, d: str) -> DataFrame:
    n = _name()
    day = F.regexp_replace(n["date"], r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    files = latest_laws(spark, d).select("file", n["title"].alias("title"), day.alias("date"), n["voided"].alias("voided"))
    return catalog.match_official(files, staged(_official(spark, d), "official")).select("file", "how", "status_code", "status", "promulgated", "effective", "layer")


def status_labels(spark: SparkSession, d: str) -> DataFrame:
    laws = latest_laws(spark, d).select("file", F.coalesce("title", F.lit("")).alias("title"), "category", F.trim("layer").alias("layer"), F.trim("status").alias("status"))
    named = laws.withColumn("label", build.category_label(F.col("category"), F.col("title")))
    return named.select("file", "label", build.status_label(F.col("status"), F.col("layer"), F.col("title"), F.col("label"), F.col("title").rlike(titles.VOID)).alias("status"))


def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of the day they were published, built into a corpus against the last delivery of the catalog."""
    t = table(spark, d, "documents").filter("title is not null")
    name = F.concat(F.regexp_replace("title", r"[/\\]", "_"), F.lit("_"), F.regexp_replace(iso_date(F.col("published")), "-", ""), F.lit(".txt"))
    paras = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), LINE_END), lambda x: stripped(F.regexp_replace(x, "^#+ ", ""))), lambda x: x != "")
    files = t.select(name.alias("name"), paras.alias("paras"), "source")
    made = build.corpus(spread(files), staged(_official(spark, d), "official"))
    return made.select("name", "category", "layer", "status", "promulgated", "effective", "effective_source", "article_count", "chars", F.length("text").alias("text_chars"))


def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    local = latest_laws(spark, d).filter("trim(layer) = 'current'").select(plain_title(F.col("title")).alias("title"), iso_date(F.col("promulgated")).alias("promulgated"), iso_date(F.col("effective")).alias("effective"))
    local = catalog.first_by(local.filter("title is not null"), ["title"], F.desc("promulgated"), F.desc("effective"))
    remote = catalog.first_by(_official(spark, d).select("title", F.coalesce("date", F.lit("")).alias("promulgated"), "effective"), ["title"], F.desc("promulgated"), F.desc("effective"))
    return catalog.catalog_diff(local, remote)


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    laws = latest_laws(spark, d).select(plain_title(F.col("title")).alias("title"), F.nullif(iso_date(F.col("promulgated")), F.lit("")).alias("promulgated"), "file")
    return catalog.newest_per_title(laws, "title", "promulgated", "file").select("title", "promulgated", "file")


def source_preference(spark: SparkSession, d: str) -> DataFrame:
    wanted = latest_laws(spark, d).select(F.col("file").alias("key"), plain_title(F.col("title")).alias("title"), iso_date(F.col("promulgated")).alias("promulgated"))
    sources = table(spark, d, "check_updates").select(plain_title(F.col("title")).alias("title"), F.nullif(iso_date(F.col("promulgated")), F.lit("")).alias("date"), F.col("snapshot").alias("path"))
    return catalog.pick_source(wanted, sources.distinct())


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "fetch_local_meta").filter("bbbs is not null")
    return catalog.first_by(t, ["bbbs"], F.asc_nulls_last("fetched_at"), F.asc_nulls_last("title")).select("bbbs", "title", "promulgated", F.unix_micros("fetched_at").alias("fetched"))


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "build_from_downloads").select("file", "retrieved", "row_id", "status")
    old, new = t.filter("retrieved < '2024-01-01'"), t.filter("retrieved >= '2024-01-01'")
    return catalog.upsert(old, new, ["file"], F.desc("retrieved"), F.desc("row_id")).select("file", "retrieved", "row_id", "status")


def title_score(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "build_from_downloads").filter("row_id % 50 = 0").select(F.col("row_id").alias("qid"), titles.clean_title(F.col("title")).alias("query"))
    entries = _official(spark, d).select("title", F.col("date").alias("promulgated"), "category")
    return catalog.title_search(staged(q, "queries"), entries)


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "check_updates")
    return t.select("snapshot", titles.clean_title(F.col("title")).alias("clean"), titles.norm_title(F.col("title")).alias("norm"), titles.core_phrase(F.col("title")).alias("core")).groupBy("snapshot", "clean", "norm", "core").agg(F.count("*").alias("n"))


def local_records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "fetch_local_meta").filter("bbbs is not null")
    return t.select("bbbs", titles.clean_title(F.col("title")).alias("title"), titles.issuer_region(F.col("issuer")).alias("region"), titles.category_rank(F.col("category")).alias("rank"), titles.match_key(F.col("title")).alias("key")).distinct()


def local_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "fetch_local_meta").filter("bbbs is not null")
    return t.groupBy("category", "status").agg(F.countDistinct("bbbs").alias("records"))


def top_regions(spark: SparkSession, d: str) -> DataFrame:
    region = titles.issuer_region(F.col("issuer"))
    t = table(spark, d, "fetch_local_meta").filter("bbbs is not null").select("bbbs", region.alias("region")).filter("region <> ''")
    return t.groupBy("region").agg(F.countDistinct("bbbs").alias("records")).orderBy(F.desc("records"), "region").limit(6)


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return latest_laws(spark, d).groupBy(F.trim("layer").alias("layer"), "category").agg(
        F.count("*").alias("laws"), F.count_if(F.col("text_status") == "full").alias("full"), F.sum(F.coalesce("article_count", F.lit(0))).alias("articles"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars")
    )


def expansion_check(spark: SparkSession, d: str) -> DataFrame:
    return catalog.expansion_use(EXPANSIONS, table(spark, d, "audit_state"), "file", "body")


def snapshot_age(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "build_from_downloads").select("retrieved").distinct()
    age = numerals.snapshot_age(F.col("retrieved"), F.to_date(F.lit(TODAY)))
    return t.select("retrieved", age.alias("age"), (age >= 180).alias("stale"))


def article_numerals(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "audit_state").select("line").filter("line between 1 and 9999").distinct()
    label = numerals.article_label(F.col("line").cast("string"))
    return n.select("line", label.alias("label"), numerals.han_to_int(numerals.to_han(F.col("line"))).alias("back"))


def effective_backfill(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", numerals.effective_in_text(F.coalesce("text", F.lit("")), F.col("published")).alias("effective"))
    return t.filter("effective <> ''")


def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    row = clause_json(*[F.col(c) for c in ("title", "article", "body", "status", "layer", "file")])
    return clauses(spark, d, None).select("key", digest(row).alias("hash"))


def clause_hash(spark: SparkSession, d: str) -> DataFrame:
    return audit.clause_hashes(clauses(spark, d, None)).select("key", "hash")


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return audit.fingerprint(clauses(spark, d, None), F.col("key"), F.col("title"), F.col("article"), F.col("body"), F.col("status"), F.col("layer"))


def exact_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The values that other implementations of the same audit reproduce: of the corpus, and of status and layer alone."""
    rows = staged(audit.clause_hashes(clauses(spark, d, None)), "hashes")
    corpus, metadata = audit.exact_fingerprint(rows, "key", "hash"), audit.exact_fingerprint(rows, "key", "status", "layer")
    return corpus.select(F.lit("corpus").alias("of"), "fingerprint", "rows").unionByName(metadata.select(F.lit("metadata").alias("of"), "fingerprint", "rows"))


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The clauses as first loaded, and as last loaded."""
    t = table(spark, d, "audit_state").filter("file is not null and line is not null")
    h = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("title", "article", "body", "status", "layer")]), 256)
    rows = t.select(F.concat_ws("#", "file", "line").alias("key"), h.alias("hash"), F.struct("loaded_at", "row_id").alias("at"))
    old = rows.groupBy("key").agg(F.min_by("hash", "at").alias("hash"))
    return old, rows.groupBy("key").agg(F.max_by("hash", "at").alias("hash"))


def index_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _states(spark, d)
    keys = table(spark, d, "build_vectors").select(F.col("keys").alias("key")).distinct()
    return audit.index_diff(old.join(keys, "key", "left_semi"), new)


def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(clauses(spark, d).select("key"), table(spark, d, "build_vectors").filter("vectors is not null").select(F.col("keys").alias("key")))


def audit_gate(spark: SparkSession, d: str) -> DataFrame:
    return audit.gate(index_diff(spark, d), index_coverage(spark, d))


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    hits = word_scores(spark, d).groupBy("qid").agg(F.count("*").alias("candidates"))
    asked = table(spark, d, "eval_queries").select(F.col("item_id").alias("qid")).join(hits, "qid", "left").select("qid", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return audit.audit_report(asked, audit_gate(spark, d), ("current",))


def checklist(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "check_updates")
    rows = t.join(F.broadcast(t.agg(F.max("snapshot").alias("s"))), t["snapshot"] == F.col("s"))  # one row
    rows = rows.select(titles.clean_title(F.col("title")).alias("title"), "category", "promulgated", "effective", "issuer", "status_code").filter("title <> ''")
    return listing.checklist(rows, catalog.STATUS_NAME).groupBy("title", "category", "promulgated", "effective", "status", "issuer").agg(F.count("*").alias("n"))


def source_index(spark: SparkSession, d: str) -> DataFrame:
    """The files of the manifest as a source tree that carries the date in brackets."""
    path = F.regexp_replace(F.regexp_replace("file", "^corpus/", ""), r"_(\d{4})(\d{2})(\d{2})\.md$", "($1-$2-$3).md")
    nodes = latest_laws(spark, d).select(path.alias("path"), F.lit("blob").alias("type"), F.col("chars").alias("size"))
    return listing.title_index(nodes, ["地方性法规", "行政法规", "自治条例"])


def stale_files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "build_from_downloads").filter("file is not null")
    last = t.agg(F.max("retrieved").alias("r"))
    return listing.stale_files(t, t.join(F.broadcast(last), t["retrieved"] == F.col("r")))  # one row


# SQL -----------------------------------------------------------------------------------------------------------------

_BL = r"[\s\x{1c}-\x{1f}\x{85}\pZ]"
_strip = lambda c: f"regexp_replace(coalesce({c}, ''), '^{_BL}+|{_BL}+$', '', 'g')"
_clean = lambda c: _strip(f"regexp_replace(coalesce({c}, ''), '<[^>]*>', '', 'g')")
_plain = lambda c: f"nullif(regexp_replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '{_BL}+', '', 'g'), '')"
_letters = lambda c: rf"regexp_replace(coalesce({c}, ''), '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g')"


def _core(c: str) -> str:
    """Three nested steps of taking off generic tails, as a chain of lambda-free subexpressions."""
    out = _letters(c)
    for _ in range(3):
        shorter = f"regexp_replace({out}, '{titles.GENERIC_TAIL}', '')"
        out = f"case when length({shorter}) >= 4 then {shorter} else {out} end"
    return out


def _region(c: str) -> str:
    out = _strip(c)
    for _ in range(3):
        out = _strip(f"regexp_replace({out}, '{titles.ISSUER_TAIL}', '')")
    return out


_STEM = r"regexp_replace(regexp_replace(file, '^.*[/\\]', ''), '(.)\.[^.]*$', '\1')"
_FILES = rf"""
names as (select *, {_STEM} as stem from laws),
titled as (select *, case when regexp_matches(stem, '^(.*)_(\d{{8}})$') then regexp_extract(stem, '^(.*)_(\d{{8}})$', 1) else stem end as t0, nullif(regexp_extract(stem, '^(.*)_(\d{{8}})$', 2), '') as stamp from names),
cut as (select *, regexp_replace(regexp_replace(regexp_replace(t0, '\+', '、', 'g'), '、{{2,}}', '、', 'g'), '^[、_\s　]+|[、_\s　]+$', '', 'g') as t1 from titled),
files as (select *, regexp_matches(t1, '{titles.VOID}') as voided, {_strip(f"regexp_replace(t1, '{titles.VOID}', '')")} as name from cut)"""
_OFFICIAL = f"""
rows_last as (select nullif(regexp_replace({_plain('title')}, '{titles.VOID}', ''), '') as title, {_sql_day('promulgated')} as date, {_sql_day('effective')} as effective, status, status_code, category, issuer, received_at
              from check_updates where snapshot = (select max(snapshot) from check_updates)),
official as (select title, nullif(date, '') as date, effective, status, status_code, category, issuer from (
  select *, row_number() over (partition by title, date order by received_at desc nulls last, effective desc, coalesce(status_code, -99) desc) as rn from rows_last where title is not null) where rn = 1)"""
_case = lambda code, t, other: "case " + " ".join(f"when {code} = {k} then '{v}'" for k, v in t.items()) + f" else '{other}' end"
_KEY = r"regexp_replace({}, '[\s　、·]+', '', 'g')"

QUERIES = {f.__name__: f for f in (
    file_names, safe_stems, catalog_match, status_labels, corpus_build, catalog_diff, latest_version, source_preference, dedup_first_wins, upsert_last_wins, title_score, html_strip, local_records,
    local_counts, top_regions, corpus_stats, expansion_check, snapshot_age, article_numerals, effective_backfill, doc_hash, clause_hash, corpus_fingerprint,
    index_diff, index_coverage, audit_gate, exact_fingerprints, audit_report, checklist, source_index, stale_files,
)}

_STATES = r"""
hashed as (select file || '#' || line as key, sha256(concat_ws('|', coalesce(title, ''), coalesce(article, ''), coalesce(body, ''), coalesce(status, ''), coalesce(layer, ''))) as hash, loaded_at, row_id
           from audit_state where file is not null and line is not null),
old as (select key, hash from (select *, row_number() over (partition by key order by loaded_at nulls first, row_id) as rn from hashed) where rn = 1 and key in (select keys from build_vectors)),
new as (select key, hash from (select *, row_number() over (partition by key order by loaded_at desc nulls last, row_id desc) as rn from hashed) where rn = 1),
diff as (select coalesce(o.key, n.key) as key, case when o.key is null then 'added' when n.key is null then 'removed' else 'changed' end as change
         from old o full outer join new n on o.key = n.key where o.hash is distinct from n.hash)"""
_COVER = f"""{CLAUSES_SQL},
cover as (select count(*) as keys, count(*) filter (key in (select keys from build_vectors where vectors is not null and keys is not null)) as covered from (select distinct key from clauses))"""
_LOCAL_LAST = f"""
local as (select * from (select title, promulgated, effective, row_number() over (partition by title order by promulgated desc, effective desc) as rn
  from (select {_plain('title')} as title, {_sql_day('promulgated')} as promulgated, {_sql_day('effective')} as effective from laws where trim(layer, ' ') = 'current') where title is not null) where rn = 1),
remote as (select * from (select title, coalesce(date, '') as promulgated, effective, row_number() over (partition by title order by coalesce(date, '') desc, effective desc) as rn from official) where rn = 1)"""
_LINE = r"""to_json({'article': coalesce(article, ''), 'body': coalesce(body, ''), 'file': coalesce(file, ''), 'law': coalesce(title, ''), 'layer': coalesce(layer, ''), 'status': coalesce(status, '')})::varchar"""



def _han_int(c: str) -> str:
    placed = f"translate({c}, '〇○零一二两三四五六七八九', '0001223456789')"
    tens = "^([一二两三四五六七八九]?)十([一二两三四五六七八九]?)$"
    digit = lambda i, empty: f"coalesce(try_cast(translate(regexp_extract({c}, '{tens}', {i}), '一二两三四五六七八九', '1223456789') as int), {empty})"
    return rf"case when regexp_matches({placed}, '^\d{{1,9}}$') then try_cast({placed} as int) when regexp_matches({c}, '{tens}') then {digit(1, 1)} * 10 + {digit(2, 0)} end"


def _compat() -> tuple[str, str]:
    """By rule: characters that NFKC turns into one other character, and NFC does not."""
    found = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xA0, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.decomposition(c).startswith("<")}
    one = {a: b for a, b in found.items() if len(b) == 1}
    return "".join(one), "".join(one.values()).replace("'", "''")


_nfkc = lambda c: f"replace(nfc_normalize(translate({c}, '{_compat()[0]}', '{_compat()[1]}')), chr(13) || chr(10), chr(10))"
_NFKC = lambda c: f"case when regexp_full_match(coalesce({c}, ''), '[\\x20-\\x7e\\x{{3001}}-\\x{{3011}}\\x{{4e00}}-\\x{{9fff}}]*') then {_strip(c)} else {_strip(_nfkc(c))} end"
_HASHES = f"""normal as (select {', '.join(f"{_NFKC(c)} as {c}" for c in ('title', 'article', 'body', 'status', 'layer', 'file'))} from all_clauses),
hashes as (select title || '/' || article as key, status, layer, 'sha256:' || sha256(to_json({{'article': article, 'body': body, 'file': file, 'law': title, 'layer': layer, 'status': status}})::varchar) as hash from normal)"""
_STATUS_SQL = "case status_code " + " ".join(f"when {k} then '{v}'" for k, v in catalog.STATUS_NAME.items()) + " else '未知(' || coalesce(status_code::varchar, 'None') || ')' end"

SQL = {
    "clause_hash": f"with {CLAUSES_SQL}, {_HASHES} select key, hash from hashes",
    "exact_fingerprints": f"""with {CLAUSES_SQL}, {_HASHES}
      select 'corpus' as of, 'sha256:' || sha256('[' || string_agg(to_json({{'hash': hash, 'key': key}})::varchar, ',' order by key, hash) || ']') as fingerprint, count(*) as rows from hashes
      union all select 'metadata', 'sha256:' || sha256('[' || string_agg(to_json({{'key': key, 'layer': layer, 'status': status}})::varchar, ',' order by key, layer, status) || ']'), count(*) from hashes""",
    "status_labels": f"""with {LAWS_SQL}, n as (select file, coalesce(title, '') as title, trim(layer, ' ') as layer, trim(status, ' ') as status,
        coalesce(nullif(category, ''), case {' '.join(f"when regexp_matches(coalesce(title, ''), '{p}') then '{c}'" for p, c in build.BY_ISSUER)} else '{build.NO_CATEGORY}' end) as label from laws)
      select file, label, case when regexp_matches(title, '{titles.VOID}') then '{build.VOID_STATUS}'
        when layer = 'decision' and coalesce(status, '') <> '' then case when regexp_matches(title, '{titles.DECISION}') or ends_with(label, '修改废止决定') then '{build.AMENDING}' else '{build.OTHER_DECISION}' end
        when coalesce(status, '') <> '' then status else '{build.NO_STATUS}' end as status from n""",
    "checklist": f"""with r as (select {_clean('title')} as title, category, promulgated, effective, issuer, status_code from check_updates where snapshot = (select max(snapshot) from check_updates))
      select title, category, coalesce(trim(promulgated, ' '), '') as promulgated, coalesce(trim(effective, ' '), '') as effective, {_STATUS_SQL} as status, coalesce(trim(issuer, ' '), '') as issuer, count(*) as n
      from r where title <> '' and (coalesce(category, '') <> '宪法' or regexp_matches(title, '修正文本|修正案')) group by all""",
    "source_index": rf"""with {LAWS_SQL}, n as (select regexp_replace(regexp_replace(file, '^corpus/', ''), '_(\d{{4}})(\d{{2}})(\d{{2}})\.md$', '(\1-\2-\3).md') as path, coalesce(chars, 0) as size from laws),
      s as (select *, regexp_extract(path, '^[^/]+/(.*)\.md$', 1) as stem from n where ends_with(path, '.md') and len(string_split(path, '/')) = 2 and split_part(path, '/', 1) in ('地方性法规', '行政法规', '自治条例') and not starts_with(split_part(path, '/', 2), '_')),
      t as (select *, trim(regexp_replace(stem, '\((\d{{4}}-\d{{2}}-\d{{2}})\)$', ''), ' ') as name, nullif(regexp_extract(stem, '\((\d{{4}}-\d{{2}}-\d{{2}})\)$', 1), '') as date from s)
      select {_strip(f"regexp_replace(regexp_replace({_clean('name')}, '^中华人民共和国', ''), '[（(][^（()）]*[)）]', '', 'g')")} as title, date, case when date is null then nullif(regexp_extract(stem, '[（(](\d{{4}})年[)）]', 1), '') end as year, path, size from t""",
    "stale_files": "select distinct file from build_from_downloads where contains(file, '/') and file not in (select file from build_from_downloads where retrieved = (select max(retrieved) from build_from_downloads) and file is not null)",
    "file_names": f"with {LAWS_SQL}, {_FILES} select file, name as title, stamp as date, voided from files",
    "catalog_match": f"""with {LAWS_SQL}, {_FILES}, {_OFFICIAL},
      f as (select file, name as title, substr(stamp, 1, 4) || '-' || substr(stamp, 5, 2) || '-' || substr(stamp, 7, 2) as date, voided from files),
      entries as (select * from (select *, row_number() over (partition by title, date order by status_code desc nulls last, status desc nulls last, effective desc nulls last) as rn from official) where rn = 1),
      t as (select * from (select *, row_number() over (partition by title order by date desc nulls last) as n from entries) where n = 1),
      k as (select * from (select *, {_KEY.format('title')} as key, row_number() over (partition by {_KEY.format('title')} order by date desc nulls last, title) as n from entries) where n = 1 and key <> ''),
      joined as (select f.file, f.title, f.date, f.voided, case when e.title is not null then 'exact' when t.title is not null then 'title' when k.title is not null then 'key' else 'none' end as how,
                   coalesce(e.title, t.title, k.title) is not null as m, case when e.title is not null then e.date when t.title is not null then t.date else k.date end as od,
                   case when e.title is not null then e.status_code when t.title is not null then t.status_code else k.status_code end as oc,
                   case when e.title is not null then e.status when t.title is not null then t.status else k.status end as os,
                   case when e.title is not null then e.effective when t.title is not null then t.effective else k.effective end as oe
                 from f left join entries e on f.title = e.title and f.date = e.date left join t on f.title = t.title left join k on {_KEY.format('f.title')} = k.key),
      judged as (select *, how in ('title', 'key') and date > od as later, how in ('title', 'key') and date < od as earlier from joined),
      coded as (select *, case when later then 3 when earlier then 2 else oc end as status_code from judged)
      select file, how, status_code, case when later then '{catalog.MERGED}' when earlier then '{catalog.SUPERSEDED}' else os end as status,
             case when later or earlier then date else od end as promulgated, case when later or earlier then '' else oe end as effective,
             case when voided then 'historical' when regexp_matches(title, '{titles.DECISION}') then 'decision' when not m then 'current' when status_code is null then 'decision'
                  else {_case('status_code', catalog.STATUS_LAYER, 'unknown')} end as layer from coded""",
    "catalog_diff": f"""with {LAWS_SQL}, {_OFFICIAL}, {_LOCAL_LAST}
      select coalesce(l.title, r.title) as title, case when l.title is null then 'added' when r.title is null then 'gone' else 'changed' end as change
      from local l full outer join remote r on l.title = r.title where l.title is null or r.title is null or l.promulgated <> r.promulgated or l.effective <> r.effective""",
    "latest_version": f"""with {LAWS_SQL} select title, promulgated, file from (select title, promulgated, file, row_number() over (partition by title order by promulgated desc nulls last, file) as rn
      from (select {_plain('title')} as title, nullif({_sql_day('promulgated')}, '') as promulgated, file from laws) where title is not null) where rn = 1""",
    "source_preference": f"""with {LAWS_SQL}, wanted as (select file as key, {_plain('title')} as title, {_sql_day('promulgated')} as promulgated from laws),
      sources as (select distinct {_plain('title')} as title, nullif({_sql_day('promulgated')}, '') as date, snapshot as path from check_updates),
      tiers as (select key, w.title, w.promulgated, date, path, case when date = w.promulgated then 0 when substr(date, 1, 4) = substr(w.promulgated, 1, 4) then 1 when date is not null then 2 else 3 end as tier
                from wanted w join sources s on w.title = s.title)
      select key, title, promulgated, date, path, tier from (select *, row_number() over (partition by key order by tier, case when tier = 2 then date end desc nulls last, path) as rn from tiers) where rn = 1""",
    "dedup_first_wins": "select bbbs, title, promulgated, epoch_us(fetched_at) as fetched from (select *, row_number() over (partition by bbbs order by fetched_at nulls last, title nulls last) as rn from fetch_local_meta where bbbs is not null) where rn = 1",
    "upsert_last_wins": "select file, retrieved, row_id, status from (select *, row_number() over (partition by file order by retrieved >= '2024-01-01' desc, retrieved desc, row_id desc) as rn from build_from_downloads) where rn = 1",
    "title_score": f"""with {_OFFICIAL},
      q as (select row_id as qid, {_letters(_clean('title'))} as phrase, {_core(_clean('title'))} as core from build_from_downloads where row_id % 50 = 0),
      ranks as (select * from (values {', '.join(f"('{k}', {v})" for k, v in titles.CATEGORY_RANK.items())}) r(category, crank)),
      entries as (select * from (select title, date as promulgated, coalesce(crank, {titles.OTHER_RANK}) as crank, {_letters('title')} as name, row_number() over (partition by title, date order by coalesce(crank, {titles.OTHER_RANK})) as rn
                  from official left join ranks using (category)) where rn = 1),
      scored as (select qid, title, promulgated, crank, name, case when phrase <> '' and name = phrase then 4.0 when core <> '' and name = core then 3.0 when core <> '' and starts_with(name, core) then 2.5
                   when core <> '' and contains(name, core) then 2.0 when phrase <> '' and contains(name, phrase) then 1.5 else 0.0 end::double as score from q, entries)
      select qid, rank, title, promulgated, score from (select *, row_number() over (partition by qid order by score desc, crank, length(name), coalesce(promulgated, '') desc, title) as rank from scored where score > 0) where rank <= 10""",
    "html_strip": f"select snapshot, {_clean('title')} as clean, {_strip(f'''regexp_replace(regexp_replace({_clean('title')}, '^中华人民共和国', ''), '[（(][^（()）]*[)）]', '', 'g')''')} as norm, {_core('title')} as core, count(*) as n from check_updates group by all",
    "local_records": f"""select distinct bbbs, {_clean('title')} as title, {_region('issuer')} as region, coalesce(v, {titles.OTHER_RANK}) as rank, {_KEY.format('title')} as key
      from fetch_local_meta left join (values {', '.join(f"('{k}', {v})" for k, v in titles.CATEGORY_RANK.items())}) r(k, v) on category = k where bbbs is not null""",
    "local_counts": "select category, status, count(distinct bbbs) as records from fetch_local_meta where bbbs is not null group by all",
    "top_regions": f"select region, count(distinct bbbs) as records from (select bbbs, {_region('issuer')} as region from fetch_local_meta where bbbs is not null) where region <> '' group by region order by records desc, region limit 6",
    "corpus_stats": f"with {LAWS_SQL} select trim(layer, ' ') as layer, category, count(*) as laws, count(*) filter (text_status = 'full') as full, sum(coalesce(article_count, 0))::bigint as articles, sum(coalesce(chars, 0))::bigint as chars from laws group by all",
    "expansion_check": "select k as key, v as value, (select count(distinct file) from audit_state where contains(body, v)) as files from (values "
    + ", ".join(f"('{k}', '{v}')" for k, vs in EXPANSIONS.items() if k[0] != "_" for v in vs) + ") e(k, v)",
    "snapshot_age": f"select distinct retrieved, date_diff('day', try_cast(retrieved as date), date '{TODAY}') as age, date_diff('day', try_cast(retrieved as date), date '{TODAY}') >= 180 as stale from build_from_downloads",
    "doc_hash": f"with {CLAUSES_SQL} select key, 'sha256:' || sha256({_LINE}) as hash from all_clauses",
    "corpus_fingerprint": f"""with {CLAUSES_SQL},
      h as (select h, count(*) as n from (select sha256(to_json([key, coalesce(title, ''), coalesce(article, ''), coalesce(body, ''), coalesce(status, ''), coalesce(layer, '')])::varchar) as h from all_clauses) group by h),
      four as (select substr(h, 1, 4) as part, sha256(string_agg(h || '=' || n, ',' order by h || '=' || n)) as d, sum(n) as n from h group by 1),
      two as (select substr(part, 1, 2) as part, sha256(string_agg(part || '=' || d, ',' order by part || '=' || d)) as d, sum(n) as n from four group by 1)
      select 'sha256:' || sha256(string_agg(part || '=' || d, ',' order by part || '=' || d)) as fingerprint, sum(n)::bigint as rows from two""",
    "index_diff": f"with {_STATES} select key, change from diff",
    "index_coverage": f"with {_COVER} select keys, covered, round(covered / greatest(keys, 1), 6) as share from cover",
    "audit_gate": f"""with {_COVER}, {_STATES}, s as (select (select count(*) from diff) as changed_clauses, (select covered / greatest(keys, 1) from cover) as share),
      g as (select case when changed_clauses > 0 then 'stale' when share < 0.99 then 'uncovered' else 'valid' end as status, changed_clauses from s)
      select status, changed_clauses, status = 'valid' as uses_vectors, case when status = 'stale' then 'conditional' else 'allowed' end as answer_gate from g""",
    "audit_report": f"""with {_bm25_sql()}, {_COVER.replace(CLAUSES_SQL + ',', '')}, {_STATES},
      hits as (select qid, count(*) as n from scores group by qid), s as (select (select count(*) from diff) as changed, (select covered / greatest(keys, 1) from cover) as share),
      g as (select case when changed > 0 then 'stale' when share < 0.99 then 'uncovered' else 'valid' end as status, changed from s)
      select item_id as qid, to_json({{'stage': case when coalesce(h.n, 0) > 0 or status = 'valid' then 'retrieved' else 'no_results' end,
        'retrieval': {{'layers': ['current'], 'method': case when status = 'valid' then 'bm25_vector_rrf' else 'bm25' end, 'candidate_count': coalesce(h.n, 0), 'historical_included': false}},
        'index': {{'status': status, 'hash_match': changed = 0, 'changed_clauses': changed}}, 'verification': {{'metadata_checked': false, 'live_checked': false}},
        'answer_gate': {{'status': case when status = 'stale' then 'conditional' else 'allowed' end, 'allowed': true, 'reason': 'retrieval_audit_only'}}}})::varchar as audit
      from eval_queries q left join hits h on q.item_id = h.qid, g""",
    "article_numerals": f"""with n as (select distinct line, lpad(line::varchar, 4, '0') as t from audit_state where line between 1 and 9999),
      spoken as (select line, {' || '.join(f"case when t[{i}] = '0' then '零' else translate(t[{i}], '123456789', '一二三四五六七八九') || '{u}' end" for i, u in ((1, '千'), (2, '百'), (3, '十'), (4, '')))} as s from n),
      han as (select line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '零+$', ''), '^零+', ''), '零+', '零', 'g'), '^一十', '十') as h from spoken)
      select line, '第' || h || '条' as label, {_han_int('h')} as back from han""",
    "effective_backfill": rf"""with m as (select doc_id, published, coalesce(text, '') as text, {', '.join(f"regexp_extract_all(coalesce(text, ''), '{numerals.EFFECTIVE}', {i}) as g{i}" for i in (1, 2, 3))} from documents),
      e as (select doc_id, generate_subscripts(g1, 1) as i, unnest(g1) as y, unnest(g2) as mo, unnest(g3) as da from m),
      v as (select doc_id, i, {_han_int('y')} as y, {_han_int('mo')} as mo, {_han_int('da')} as da from e),
      last as (select doc_id, arg_max(printf('%04d-%02d-%02d', y, mo, da), i) as day from v where y > 0 and mo > 0 and da > 0 group by doc_id),
      r as (select m.doc_id, coalesce(day, case when coalesce(published, '') <> '' and regexp_matches(text, '{numerals.FROM_PUBLICATION}') then published else '' end) as effective from m left join last on m.doc_id = last.doc_id)
      select doc_id, effective from r where effective <> ''""",
}
