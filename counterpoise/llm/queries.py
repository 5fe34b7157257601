"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, new_path
from . import (
    decontaminate, fingerprints, jaccard_join, lexical, line_dedup, mixing, personal_data, quality, spelling, suffix_dedup,
    token_rollup, topk, url_cascade,
)

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query("op1_url_cascade", """
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
ruled as (
  select *, case
    when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
    when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
    when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/'
    when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/'
    when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule from parts)
select *, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from ruled
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_line_dedup", """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
many as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
marked as (select k.*, m.key is not null and k.doc_id < m.keeper as gone from keyed k left join many m on k.key = m.key)
select doc_id, count(*)::BIGINT as n_lines, sum(gone::INT)::BIGINT as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).withColumn("places", F.to_json("places"))


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))


@query("op4_personal_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in personal_data.KINDS],
        F.sha2(personal_data.spelled(F.col("base")), 256).alias("base_sha256"),
        personal_data.spelled(F.col("spans")).alias("spans"), F.sha2("clean", 256).alias("clean_sha256"),
    )


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@query("op5_token_rollup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: counts of two tokenizers come in, exact
    copies go, counts of one tokenizer are revised by the end-of-text token, and the batch of
    deletes is sent once more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumns({
        "words": F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long"),
        "digest": F.xxhash64(F.coalesce("text", F.lit("")), F.length("text")),
    })
    counted = materialize(token_rollup.count_tokens(docs, VOCABULARY, SPLIT), "token-counts")
    plain = counted.select("doc_id", "source", "lang", F.lit("words").alias("tokenizer"), F.col("words").alias("tokens"))
    pieces = counted.select("doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), "tokens")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("_first"))
    copies = counted.join(first, "digest").where(F.col("doc_id") != F.col("_first"))
    none = F.lit(None)
    deletes = copies.select(
        F.lit("delete").alias("op"), "doc_id", "source", "lang", none.cast("string").alias("tokenizer"), none.cast("long").alias("tokens")
    )
    kept = pieces.join(copies.select("doc_id"), "doc_id", "left_anti")
    ledger = token_rollup.TokenLedger(spark, new_path(spark, "token-ledger"))
    ledger.commit(1, plain.unionByName(pieces).withColumn("op", F.lit("insert")))
    ledger.commit(2, deletes)
    ledger.commit(3, kept.withColumn("op", F.lit("revise")).withColumn("tokens", F.col("tokens") + 1))
    ledger.commit(2, deletes)
    return ledger.totals()


@query("op8_topk", """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::INTEGER as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # a cut can split a character, so the text left is shown as valid UTF-8
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query("op11_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_spelling", """
with recursive bits as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: case when c % 2 = 1 then xor(3988292384::UBIGINT, c // 2) else c // 2 end)) as tab),
runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 5 group by doc_id, run),
hashed as (
  select run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(
    string_split(doc_id::VARCHAR || ':' || run, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)::UBIGINT]
      else [(192 + unicode(ch) // 64)::UBIGINT, (128 + unicode(ch) % 64)::UBIGINT] end))),
    lambda c, b: xor(tab[(xor(c % 256, b) + 1)::BIGINT], c // 256))) as h from runs, bits),
words as (
  select word, sum(n)::BIGINT as n from (
    select n, case when h % 97 = 0 then substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                   else run end as word from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3),
cuts as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word),
best as (
  select word, count(*)::BIGINT as n_near, first(other order by n desc, other) as other, max(n) as best_n from near group by word),
forms as (
  select w.word, w.n, coalesce(b.n_near, 0)::BIGINT as n_near, case when b.best_n >= 2 * w.n then b.other end as form,
         case when b.best_n >= 2 * w.n then b.best_n end as form_n from words w left join best b on w.word = b.word),
chain as (
  select word, word as at, 0 as step from forms
  union all select c.word, f.form, step + 1 from chain c join forms f on c.at = f.word where f.form is not null)
select f.word, f.form, (select max_by(c.at, c.step) from chain c where c.word = f.word) as root, f.n, f.n_near, f.form_n from forms f
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", dropout=97)
    return spelling.group_variants(words)


@query("op13_lexical_search", r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
sizes as (select doc_id, count(*)::BIGINT as n from terms group by doc_id),
whole as (select count(*)::BIGINT as docs, sum(n)::BIGINT as len from sizes),
held as (select doc_id, term, count(*)::BIGINT as tf from terms where term in (select term from asked) group by doc_id, term),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT as w from held, whole group by term, docs),
lengths as (select doc_id, 50 + (50 * n * docs) // len as m from sizes, whole),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT as score
  from asked join held using (term) join weights using (term) join lengths using (doc_id) group by item_id, doc_id),
ranked as (select *, (row_number() over (partition by item_id order by score desc, doc_id))::INTEGER as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
