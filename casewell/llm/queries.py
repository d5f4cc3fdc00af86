"""The operators of this folder applied to the given tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewell.llm import (bpe, lexical_search, license_scan, main_text, mixing, ngram_join, norm_search, plane_files, quality,
                          spelling_groups, token_counts, url_lists, vector_dedup)
from casewell.llm.common import table
from casewell.settings import ensure_checkpoint_dir

BPE_RANKS, BPE_JSON, PIECE_MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def license_notices(spark: SparkSession, folder: str) -> DataFrame:
    """op1: license notices in every document."""
    return license_scan.scan(table(spark, folder, "documents"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts: some are blocked for a while, some paths of them allowed, some parents blocked."""
    host = url_lists.host_of(F.col("url"))
    section = F.regexp_extract("url", "^[^:]+://[^/]+/([^/?#]+)", 1)
    hosts = pages.select(host.alias("host"), section.alias("section")).where("host is not null").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 180).cast("int"))

    def rows(chosen: str, pattern, verdict: str, *days: tuple[str, int]) -> DataFrame:
        parts = [hosts.where(chosen).select(pattern.alias("pattern"), F.lit(action).alias("action"), F.lit(verdict).alias("verdict"),
                                            F.date_add(first, after).alias("dated")) for action, after in days]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    parent = F.substring_index("host", ".", -3)
    return (rows("h % 4 = 0", F.col("host"), "block", ("add", 0), ("remove", 45), ("add", 120))
            .union(rows("h % 8 = 0 and section <> ''", F.concat_ws("/", "host", "section"), "allow", ("add", 10), ("remove", 150)))
            .union(rows("h % 64 = 1", parent, "block", ("add", 30))).distinct())


def url_captures(spark: SparkSession, folder: str) -> DataFrame:
    """op9: every page held against the list as it stood on the day it was fetched."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(360)).cast("int"))
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_lists.judge(pages.withColumn("fetched_on", day), dated_entries(pages))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """op2: every document's base counts and verdict."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, quality.reference_table(docs), quality.PRODUCTION)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance",
             "word_distance"]
    return judged.select("doc_id", *[F.col(f"_{c}").alias(c) for c in names])


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """op3: every page's main text."""
    return main_text.extract(table(spark, folder, "pages"))


def vector_groups(spark: SparkSession, folder: str) -> DataFrame:
    """op10: every vector's number of links with a cosine of 0.95 or more, and its group."""
    return vector_dedup.near_duplicates(table(spark, folder, "embeddings"), least=0.95)


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """op5: what the mix takes of every document, in the order of training."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    taken = mixing.assign(docs).select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "taken")],
                                       F.try_element_at("_positions", F.lit(1)).alias("position"))
    return taken.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """op4: every document encoded and decoded."""
    import public_tokenizers

    return bpe.encode_decode(table(spark, folder, "documents"), vocabulary(BPE_RANKS), public_tokenizers.PATTERN,
                             with_ids=False)


def ngram_groups(spark: SparkSession, folder: str) -> DataFrame:
    """op6: every document's group of 4-word shingle sets with a Jaccard index of 0.85 or more."""
    return ngram_join.jaccard_groups(table(spark, folder, "documents"), width=4, num=85, den=100)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """op7: every document's ids written as plane files and read back."""
    with open(vocabulary(BPE_JSON), encoding="utf-8") as f:
        spec = f.read()
    path = scratch(spark, "tokens")
    plane_files.write_tokens(table(spark, folder, "documents"), spec, path, end_id=0)
    return plane_files.read_tokens(spark, path, with_ids=False)


def piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    """op8: every document's number of tokens."""
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary(PIECE_MODEL))


def ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """op11: the 50 best documents of every benchmark item."""
    return lexical_search.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"), limit=50)


def spelling_forms(spark: SparkSession, folder: str) -> DataFrame:
    """op12: the spelling variants among all words of the documents."""
    return spelling_groups.spelling_variants(table(spark, folder, "documents"))


def top_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """op13: the 20 highest products of every twentieth vector with all others."""
    return norm_search.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, limit=20)


QUERIES = {
    "op1_license_scan": license_notices,
    "op9_url_lists": url_captures,
    "op2_quality_divergence": quality_rules,
    "op3_main_text": page_texts,
    "op5_source_mix": source_mix,
    "op10_vector_forest": vector_groups,
    "op4_byte_bpe": byte_bpe,
    "op6_ngram_jaccard": ngram_groups,
    "op7_token_planes": token_files,
    "op8_token_counts": piece_counts,
    "op11_lexical_search": ranked_documents,
    "op12_spelling_groups": spelling_forms,
    "op13_norm_buckets": top_vectors,
}

ORACLE: dict[str, str] = {
    "op9_url_lists": r"""
with p as (
  select page_id, url, date '2024-01-01' + (page_id * 37 % 360)::int as fetched_on,
    nullif(rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') as host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(url, '^[^:]+://[^/]+/([^/?#]+)', 1) as section from pages),
h as (select distinct host, section, ('0x' || substr(md5(host), 1, 4))::int as h from p where host is not null),
e as (
  select host as pattern, a as action, 'block' as verdict, date '2024-01-01' + (h % 180 + d)::int as dated
  from h, (values ('add', 0), ('remove', 45), ('add', 120)) v(a, d) where h % 4 = 0
  union select host || '/' || section, a, 'allow', date '2024-01-01' + (h % 180 + d)::int
  from h, (values ('add', 10), ('remove', 150)) v(a, d) where h % 8 = 0 and section <> ''
  union select array_to_string(string_split(host, '.')[-3:], '.'), 'add', 'block', date '2024-01-01' + (h % 180 + 30)::int
  from h where h % 64 = 1),
i as (
  select pattern, action, verdict, dated as valid_from, lead(dated) over (partition by pattern
    order by dated, action = 'add', verdict) as valid_to from e),
m as (
  select p.page_id, p.url, i.pattern, i.verdict, row_number() over (partition by p.page_id, p.url
    order by contains(i.pattern, '/') desc, length(i.pattern) desc, i.pattern desc, i.verdict desc) as k
  from p join i on i.action = 'add' and i.valid_from <= p.fetched_on and (i.valid_to is null or p.fetched_on < i.valid_to)
    and (i.pattern = p.host or ends_with(p.host, '.' || i.pattern)
      or starts_with(p.host || '/' || array_to_string(list_filter(string_split(p.path, '/'), lambda x: x <> ''), '/') || '/', i.pattern || '/') and contains(i.pattern, '/')))
select p.page_id, p.url, p.fetched_on, m.pattern as matched_pattern, m.verdict as matched_verdict,
  coalesce(m.verdict = 'block', false) as blocked
from p left join m on p.page_id = m.page_id and p.url = m.url and m.k = 1""",
    "op5_source_mix": """
with base as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as place,
    md5(coalesce(text, '')) as tie
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k
  from base group by source),
weighted as (
  select *, (case k % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight,
    (case k % 3 when 0 then 1.25 when 1 then 1.0 else 0.5 end)::double as w0,
    (case k % 3 when 0 then 0.75 when 1 then 1.0 else 1.5 end)::double as w1,
    (3 * source_size)::double as lim from sources),
levels as (
  select *, lim / weight as level,
    (sum(source_size) over () - coalesce(sum(lim) over fullest, 0)) / (sum(weight) over () - coalesce(sum(weight) over fullest, 0)) as share
  from weighted window fullest as (order by lim / weight, k rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, w0, w1,
    least(lim, max(share) over () * weight) as target
  from levels),
streams as (
  select b.doc_id, b.size, t.source_size, t.target, w0, w1,
    coalesce(sum(size) over (partition by b.source order by place, b.doc_id nulls first, tie
      rows between unbounded preceding and 1 preceding), 0) + size / 2.0 as middle
  from base b join targets t on b.source is not distinct from t.source),
taken as (
  select *, case when size > 0 then (middle < target)::int + (middle + source_size < target)::int + (middle + 2 * source_size < target)::int
    else 0 end as rounds from streams)
select doc_id, size, source_size, target, (rounds * size)::bigint as taken,
  case when rounds > 0 then least(1.0, 2 * (middle / target * (w0 + w1) / 2)
    / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * (middle / target * (w0 + w1) / 2), 0)))) end as position
from taken""",
    "op11_lexical_search": r"""
with words as (
  select row_number() over () as k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
docs as (select k, doc_id, len(words)::bigint as n, words from words where len(words) > 0),
s as (select count(*)::bigint as docs, sum(n)::bigint as total from docs),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
postings as (
  select k, doc_id, n, term, count(*)::bigint as tf from (select k, doc_id, n, unnest(words) as term from docs)
  where term in (select term from asked) group by all),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from postings, s group by term),
scored as (
  select item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint as score
  from asked join postings using (term) join weights using (term), s group by all),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50""",
    "op12_spelling_groups": r"""
with recursive codes as materialized (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
    from (select unnest(range(256)) as i))),
runs as (
  select doc_id, run, count(*)::bigint as c from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{00C0}-\x{00FF}]+')) as run from documents)
  where length(run) >= 5 group by all),
coded as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from runs),
checked as (
  select run, c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::int + 1, 2))::bigint)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc
  from coded, codes),
words as materialized (
  select word, sum(c)::bigint as n from (
    select case when crc % 97 = 0 then substr(run, 1, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word, c
    from checked) where length(word) >= 5 group by word having sum(c) >= 3),
less as materialized (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, unnest(range(1, length(word) + 1))::int as i from words)),
pairs as (
  select l.word as a, w.word as b from less l join words w on l.rest = w.word
  union select w.word, l.word from less l join words w on l.rest = w.word
  union select l.word, r.word from less l join less r on l.rest = r.rest and l.i = r.i and l.word <> r.word),
best as (
  select a, count(*)::bigint as n_near, min({'m': -n, 'b': b}) as best from pairs join words on b = word group by a),
forms as materialized (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when -best.m >= 2 * n then best.b end as form,
    case when -best.m >= 2 * n then -best.m end::bigint as form_n
  from words left join best on word = a),
walk as (
  select word, word as root, form as ahead from forms
  union all select w.word, f.word, f.form from walk w join forms f on w.ahead = f.word)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n from forms f join walk w on f.word = w.word and w.ahead is null""",
    "op13_norm_buckets": """
with v as (
  select row_number() over () as k, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.k, q.vec_id as query_id, p.vec_id, list_inner_product(q.e, p.e)::bigint as score
  from v q join v p on q.vec_id % 20 = 0 and q.k <> p.k),
ranked as (
  select *, row_number() over (partition by k order by score desc, vec_id nulls last)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20""",
}
