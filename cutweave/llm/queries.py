"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.functions.storage import table
from cutweave.llm import bpe, chat, divergence, embeddings, fingerprints, jaccard, language_model, line_dedup, mixing, passages, periodic, quality, url_filter

URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIX_WEIGHTS = (5, 2, 1)
QUALITY_FOLDS, QUALITY_SCORE = 5, 0.3


def vocabulary() -> str:
    """Path of the public vocabulary file with word ends; CUTWEAVE_TOKENIZER names another one."""
    if given := os.environ.get("CUTWEAVE_TOKENIZER"):
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url and label (1: of low quality), by the document number that a page's path ends in."""
    number = F.regexp_extract("url", r"^[^:]*://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    urls = table(spark, sf_dir, "pages").select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").select("doc_id", (1 - F.col("quality")).alias("label"))
    return urls.join(labels, "doc_id").select("url", "label")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(labelled_urls(spark, sf_dir))
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES).drop("url")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"))
    return out.select("doc_id", "lines_removed", F.col("n_chars").alias("chars_left"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP3_SQL = """
with l as (
  select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
  from documents where doc_id is not null and text is not null),
k as (select *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from l),
b as (select body, min(doc_id) as first_doc from k where body <> '' group by body having count(distinct coalesce('=' || source, '')) >= 6),
f as (select k.*, b.body is not null and k.doc_id <> b.first_doc as gone from k left join b on k.body = b.body),
d as (select doc_id, sum(gone::int)::int as lines_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from f group by doc_id)
select documents.doc_id, coalesce(lines_removed, 0)::int as lines_removed,
       case when coalesce(lines_removed, 0) = 0 then n_chars else length(d.text) end::bigint as chars_left, md5(coalesce(d.text, '')) as text_md5
from documents left join d on documents.doc_id = d.doc_id"""


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary(), ids=False, digests=True).drop("text")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS).drop("source")


OP6_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '#0'), 1, 15))::bigint as k
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5, 2, 1])[((row_number() over (order by source is null, encode(source)) - 1) % 3) + 1]::bigint as w,
             (3 * source_size)::bigint as cap from s),
o as (select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0))::bigint as l, (sum(w) over () - coalesce(sum(w) over b, 0))::bigint as ws
      from w window b as (order by cap / w, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
f as (select l, ws from o where cap * ws > l * w order by ws desc limit 1),
t as (select source, source_size, case when o.cap * o.ws > o.l * o.w then (f.l * o.w) / f.ws else o.cap::double end as target from o left join f on true),
p as (select d.*, t.source_size, t.target, floor(t.target)::bigint as budget,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when source_size = 0 then 0 else (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) end::bigint as taken
from p"""


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


OP9_SQL = """
with u as (select *, row_number() over () as row_no from conversations),
t as (select conv_id, turn, role, text, case when conv_id is null then 'row ' || row_no else 'conv ' || conv_id end as conv,
    coalesce(length(role)::varchar || ':' || role, '-') || '|' || coalesce(length(text)::varchar || ':' || text, '-') as part from u),
k as (select *, row_number() over (partition by conv order by turn nulls first, role nulls first, text nulls first) as k,
    (dense_rank() over (partition by conv order by floor(turn / 1024) nulls first) - 1)::int as chunk from t),
p as (select conv_id, conv, k, string_agg(part, '|') over (partition by conv order by k rows between unbounded preceding and current row) as prefix,
             count(*) over (partition by conv) as n from k),
w as (select prefix, min(conv_id) as conv_id, arg_min(conv, coalesce(conv_id, 9223372036854775807)) as conv, count(*)::bigint as n_equal, any_value(n)::bigint as n_turns from p where k = n group by prefix),
m as (select * from w where prefix not in (select prefix from p where k < n)),
r as (select conv, case when conv_id is null then 0 else chunk end as part, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' order by k) as text from k group by 1, 2)
select m.conv_id, m.n_turns, m.n_equal, r.part, r.text from m join r on m.conv = r.conv"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = table(spark, sf_dir, "labels").where(quality.fold(F.col("doc_id"), QUALITY_FOLDS) != 0)
    scored = quality.score_documents(docs, quality.train(docs, learnt))
    held = quality.fold(F.col("doc_id"), QUALITY_FOLDS) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= QUALITY_SCORE, 1).otherwise(0).alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = """
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row_no, text from documents),
w as (select lang, source, row_no, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
o as (select lang, source, row_no, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from w),
k as (select lang, term, count(*) as n from o group by lang, term having count(distinct row_no) >= 3),
v as (select lang, count(*) as terms, sum(n) as total from k group by lang),
c as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by lang, source, term),
g as (select lang, source, coalesce(any_value(terms), 0) as terms, coalesce(sum(n), 0) as total
      from (select distinct lang, source from d) left join v using (lang) left join c using (lang, source) group by lang, source),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000 * (coalesce(c.n, 0) + 1)::hugeint) // (g.total + g.terms))::hugeint as p
      from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, (1 + (1000000000 * (n + 1)::hugeint) // (total + terms))::hugeint as q from k join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
s as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
      union all
      select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from s)
select * from r where part = 'pair' or rank <= 200"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), periodic.with_tandem(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.digests(periodic.periodic_runs(docs).drop("text"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_ngram_jaccard_join, op3_line_dedup, op4_bpe_encoding, op5_embedding_near_dedup,
        op6_source_mixing, op7_document_fingerprints, op8_lm_scoring, op9_chat_formatting, op10_quality_classifier,
        op11_source_divergence, op12_periodic_runs, op13_substring_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op6_source_mixing": OP6_SQL, "op9_chat_formatting": OP9_SQL, "op11_source_divergence": OP11_SQL}
