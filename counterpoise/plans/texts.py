"""Queries on documents: vectors, collocations, hashed encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.info import llr_sql
from ..operators import colloc, encode, text
from ..sources.io import gather
from .base import Tables, query, r6, r6_sql, u_sql

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOK = f"""tok as materialized (select doc_id, list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]+)', 1),
 lambda w: w not in ({_STOP})) as tokens from documents)"""
WORDS = f"{TOK}, words as materialized (select doc_id, unnest(range(len(tokens))) as pos, unnest(tokens) as term from tok)"
TF = f"""{WORDS}, counts as (select term, count(*) as n from words group by term having count(*) >= 2),
dict as materialized (select term, row_number() over (order by {u_sql('dictionary', 'term')}, term) - 1 as term_id from counts),
tf as materialized (select doc_id, term_id, count(*) as tf from words join dict using (term) group by all)"""
DF = f"""{TF}, nd as (select count(distinct doc_id) as n from tf),
df as materialized (select term_id, count(*) as df from tf group by term_id)"""
TFIDF = f"""{DF}, w as materialized (select doc_id, term_id, sqrt(tf) * (ln(n / (greatest(df, 3) + 1)) + 1) as val
 from tf join df using (term_id), nd where 100.0 * df / n <= 40)"""


def _tokens(t: Tables) -> DataFrame:
    return text.tokenize(t.texts, "doc_id", "text")


def _gathered(t: Tables) -> DataFrame:
    """Tokens for counts by document: whole texts are shuffled, not their terms."""
    return text.tokenize(gather(t.texts, "doc_id"), "doc_id", "text")


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    weighted, ids = text.frequency_vectors(_gathered(t), "doc_id", 2)
    return weighted, ids


def _tfidf(t: Tables, **options) -> DataFrame:
    return text.sparse_vectors(t.texts, "doc_id", "text", min_df=3, max_df_pct=40.0, **options)[0]


@query("tokens", f"with {WORDS} select doc_id, pos::INTEGER as pos, term from words")
def tokens(t: Tables) -> DataFrame:
    return text.token_rows(_tokens(t), "doc_id")


@query("term_counts", f"with {WORDS} select term, count(*) as n from words group by term having count(*) >= 2")
def term_counts(t: Tables) -> DataFrame:
    return text.term_counts(_tokens(t), 2)


@query("dictionary", f"with {TF} select term, term_id from dict")
def dictionary(t: Tables) -> DataFrame:
    return _vectors(t)[1]


@query("tf", f"with {TF} select doc_id, term_id, tf from tf")
def tf(t: Tables) -> DataFrame:
    return _vectors(t)[0]


@query("tf_empty_documents", f"with {TF} select doc_id from documents where doc_id not in (select doc_id from tf)")
def tf_empty_documents(t: Tables) -> DataFrame:
    return text.empty_documents(t.documents, _vectors(t)[0], "doc_id")


@query("df", f"with {DF} select term_id, df from df")
def df(t: Tables) -> DataFrame:
    return text.document_frequency(_vectors(t)[0])


@query("feature_counts", f"with {DF} select n as documents, (select max(term_id) + 1 from tf) as features from nd")
def feature_counts(t: Tables) -> DataFrame:
    return text.feature_counts(_vectors(t)[0], "doc_id")


@query("tfidf", f"with {TFIDF} select doc_id, term_id, {r6_sql('val')} as val from w")
def tfidf(t: Tables) -> DataFrame:
    return _tfidf(t).withColumn("val", r6("val"))


_SIGMA = f"""{DF}, lim as (select floor(100.0 * 3 * (select sqrt(sum(df::DOUBLE * df) / (count(*) - 1)) from df) / n) as pct, n from nd),
keep as (select term_id from df, lim where 100.0 * df / n <= pct)"""


@query("tfidf_sigma", f"""with {_SIGMA}, kept as materialized (select tf.* from tf join keep using (term_id)),
n2 as (select count(distinct doc_id) as n from kept), d2 as (select term_id, count(*) as df from kept group by term_id)
select doc_id, term_id, {r6_sql('sqrt(tf) * (ln(n / (df + 1)) + 1)')} as val from kept join d2 using (term_id), n2""")
def tfidf_sigma(t: Tables) -> DataFrame:
    found = text.sparse_vectors(t.texts, "doc_id", "text", max_df_pct=100.0, sigma=3.0)[0]
    return found.withColumn("val", r6("val"))


@query("tf_norm2", f"""with {TF} select doc_id, term_id, {r6_sql('tf / sqrt(sum(tf::DOUBLE * tf) over (partition by doc_id))')} as val from tf""")
def tf_norm2(t: Tables) -> DataFrame:
    found = text.sparse_vectors(t.texts, "doc_id", "text", weight="tf", max_df_pct=100.0, power=2.0)[0]
    return found.withColumn("val", r6("val"))


@query("tf_norm_inf", f"""with {TF} select doc_id, term_id, {r6_sql('tf / max(tf) over (partition by doc_id)')} as val from tf""")
def tf_norm_inf(t: Tables) -> DataFrame:
    found = text.sparse_vectors(t.texts, "doc_id", "text", weight="tf", max_df_pct=100.0, power=float("inf"))[0]
    return found.withColumn("val", r6("val"))


@query("tf_norm0", f"""with {TF} select doc_id, term_id, {r6_sql('tf / count(*) over (partition by doc_id)')} as val from tf""")
def tf_norm0(t: Tables) -> DataFrame:
    found = text.sparse_vectors(t.texts, "doc_id", "text", weight="tf", max_df_pct=100.0, power=0.0)[0]
    return found.withColumn("val", r6("val"))


@query("tf_lognorm", f"""with {TF} select doc_id, term_id,
 {r6_sql('ln(1 + tf) / (ln(2) * sqrt(sum(tf::DOUBLE * tf) over (partition by doc_id)))')} as val from tf""")
def tf_lognorm(t: Tables) -> DataFrame:
    found = text.sparse_vectors(t.texts, "doc_id", "text", weight="tf", max_df_pct=100.0, power=2.0, log=True)[0]
    return found.withColumn("val", r6("val"))


@query("tfidf_custom_weight", f"""with {DF}, f as (select max(term_id) + 1 as length from tf)
select doc_id, term_id, {r6_sql('tf / ln(1 + length) * ln(1 + n / df::DOUBLE)')} as val
from tf join df using (term_id), nd, f where 100.0 * df / n <= 99""")
def tfidf_custom_weight(t: Tables) -> DataFrame:
    def formula(tf, df, length, n_docs):
        return tf / F.ln(1 + length) * F.ln(1 + n_docs / df)

    return text.weigh(_vectors(t)[0], "doc_id", formula).withColumn("val", r6("val"))


@query("tfidf_normalized", f"with {TFIDF} select doc_id, term_id, {r6_sql('val / sqrt(sum(val * val) over (partition by doc_id))')} as val from w")
def tfidf_normalized(t: Tables) -> DataFrame:
    return _tfidf(t, power=2.0).withColumn("val", r6("val"))


@query("partial_vector_merge", f"""with {TF} select doc_id, term_id, {r6_sql('2 * tf')} as val from tf""")
def partial_vector_merge(t: Tables) -> DataFrame:
    part = _vectors(t)[0].select("doc_id", "term_id", F.col("tf").cast("double").alias("val"))
    return text.merge_partial(part.unionByName(part), "doc_id")


@query("sliding_ngrams", f"""with {WORDS}, g as (select w.doc_id, w.pos, n from words w, (select unnest(range(0, 2)) as n) where true),
pairs as (select a.term as a, lead(a.term) over (partition by doc_id order by pos) as b, a.pos, a.doc_id from words a),
grams as (select a as gram from pairs where pos = 0 union all
 select a from pairs where b is not null union all select a || ' ' || b from pairs where b is not null)
select gram, count(*) as n from grams group by gram""")
def sliding_ngrams(t: Tables) -> DataFrame:
    grams = text.sliding_ngrams(_tokens(t), "doc_id", 2)
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("labelled_ngrams", f"""with {WORDS}, pairs as (select tokens[1] as label, w.term as a, lead(w.term) over (partition by doc_id order by pos) as b, pos
 from words w join tok using (doc_id) where pos > 0),
grams as (select label, a as gram from pairs where pos = 1 union all
 select label, a from pairs where b is not null union all select label, a || ' ' || b from pairs where b is not null)
select label, gram, count(*) as n from grams group by all""")
def labelled_ngrams(t: Tables) -> DataFrame:
    return text.labelled_ngrams(_tokens(t), "doc_id", 2).groupBy("label", "gram").agg(F.count(F.lit(1)).alias("n"))


# collocations

_SHINGLES = f"""{WORDS}, seq as materialized (select doc_id, pos, term, lead(term, 1) over o as t1, lead(term, 2) over o as t2
 from words window o as (partition by doc_id order by pos))"""
_BI = f"{_SHINGLES}, grams as materialized (select term as head, t1 as tail, count(*) as freq from seq where t1 is not null group by all)"
_TOTALS = f"""{_BI}, h as (select head, sum(freq)::BIGINT as head_total from grams group by head),
tl as (select tail, sum(freq)::BIGINT as tail_total from grams group by tail),
tot as materialized (select head || ' ' || tail as gram, head, tail, freq, head_total, tail_total from grams join h using (head) join tl using (tail) where freq >= 2)"""


@query("shingles", f"""with {_SHINGLES}, g as (select doc_id, term as head, t1 as tail from seq where t1 is not null
 union all select doc_id, term || ' ' || t1, t2 from seq where t2 is not null)
select doc_id, head, tail, count(*) as freq from g group by all""")
def shingles(t: Tables) -> DataFrame:
    return colloc.shingles(_gathered(t), "doc_id", 3)


@query("ngram_totals", f"with {_TOTALS} select gram, head, tail, freq, head_total, tail_total from tot")
def ngram_totals(t: Tables) -> DataFrame:
    return colloc.ngram_totals(_tokens(t), 2, 2)


_K = "freq::DOUBLE", "(head_total - freq)::DOUBLE", "(tail_total - freq)::DOUBLE", "(n - (head_total + tail_total - freq))::DOUBLE"


@query("collocations_llr", f"""with {_TOTALS}, nt as (select sum(freq)::BIGINT as n from grams)
select gram, 'ngram' as kind, freq, {r6_sql('score', 3)} as score from (select *, {llr_sql(*_K)} as score from tot, nt) where score >= 1
union all select term, 'unigram', count(*), count(*)::DOUBLE from words group by term having count(*) >= 2""")
def collocations_llr(t: Tables) -> DataFrame:
    found = colloc.collocations(_tokens(t), "doc_id", 2, 2, 1.0, unigrams=True)
    return found.withColumn("score", r6("score", 3))


# hashed encodings

def _slot(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT % 5000)::BIGINT"


_BRANDS = "brands as (select p_brand as word, ln((select count(*) from part) / count(*)) as weight from part where p_size > 10 and p_brand <> 'Brand#1' group by 1)"


@query("hash_word", f"""with {_BRANDS}, w as (select p_partkey, p_brand, coalesce(weight, (select min(weight) / 2 from brands)) as weight
 from part left join brands on p_brand = word)
select p_partkey as "row", col, {r6_sql('sum(weight)')} as val from (
 select p_partkey, {_slot("'p_brand'", 'p_brand', '100 + p')} as col, weight from w, (select unnest([0, 1]) as p)) group by all""")
def hash_word(t: Tables) -> DataFrame:
    part = t.part.where((F.col("p_size") > 10) & (F.col("p_brand") != "Brand#1"))
    n = t.part.agg(F.count(F.lit(1))).scalar()
    weights = part.groupBy(F.col("p_brand").alias("word")).agg(F.count(F.lit(1)).alias("c")).withColumn("weight", F.ln(n / F.col("c")))
    return encode.encode_word(t.part, "p_partkey", "p_brand", weights=weights).withColumn("val", r6("val"))


@query("hash_adaptive", f"""with c as (select p_partkey, p_type, count(*) over (partition by p_type order by p_partkey) as c,
 row_number() over (order by p_partkey) as n from part),
d as (select *, sum(case when c = 1 then 1 else 0 end) over (order by p_partkey) as k from c),
w as (select p_partkey, p_type, -ln((c + 0.5) / (n + 0.5 * k + 0.5)) as w from d)
select p_partkey as "row", col, {r6_sql('sum(w)')} as val from (
 select p_partkey, {_slot("'p_type'", 'p_type', '100 + p')} as col, w from w, (select unnest([0, 1]) as p)) group by all""")
def hash_adaptive(t: Tables) -> DataFrame:
    return encode.encode_adaptive(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type").withColumn("val", r6("val"))


@query("hash_adaptive_batch", f"""with c as (select p_type, count(*) as c from part group by 1),
w as (select p_partkey, p_type, -ln((c + 0.5) / ((select count(*) from part) + 0.5 * (select count(*) from c) + 0.5)) as w from part join c using (p_type))
select p_partkey as "row", col, {r6_sql('sum(w)')} as val from (
 select p_partkey, {_slot("'p_type'", 'p_type', '100 + p')} as col, w from w, (select unnest([0, 1]) as p)) group by all""")
def hash_adaptive_batch(t: Tables) -> DataFrame:
    found = encode.encode_adaptive(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type", running=False)
    return found.withColumn("val", r6("val"))


@query("hash_text", f"""with w as (select doc_id, token, count(*) as c from (select doc_id, unnest(regexp_extract_all(text, '(\\w+)', 1)) as token from documents) group by all)
select doc_id as "row", col, {r6_sql('sum(v)')} as val from (
 select doc_id, {_slot("'text'", 'token', '100 + p')} as col, ln(1 + c) / ln(2) as v from w, (select unnest([0, 1]) as p)) group by all""")
def hash_text(t: Tables) -> DataFrame:
    return encode.encode_text(t.texts, "doc_id", "text").withColumn("val", r6("val"))


@query("hash_numeric", f"""select p_partkey as "row", col, {r6_sql('sum(v)')} as val from (
 select p_partkey, {_slot("'p_retailprice'", '0')} as col, p_retailprice as v from part
 union all select p_partkey, {_slot("'bias'", '0')}, 1 from part) group by all""")
def hash_numeric(t: Tables) -> DataFrame:
    price = encode.encode_continuous(t.part, "p_partkey", "p_retailprice")
    bias = encode.encode_constant(t.part, "p_partkey", "bias")
    return encode.encode(t.part, "p_partkey", [price, bias]).withColumn("val", r6("val"))


@query("hash_interaction", f"""with bw as (select p_brand, 1 + count(*) / 1000.0::DOUBLE as w from part where p_size <= 25 group by 1),
tw as (select p_type, 2 + min(p_size) / 10.0::DOUBLE as w from part where p_size > 25 group by 1),
rows as (select p_partkey, p_brand, p_type, coalesce(bw.w, (select min(w) / 2 from bw)) * coalesce(tw.w, (select min(w) / 2 from tw)) as w
 from part left join bw using (p_brand) left join tw using (p_type))
select p_partkey as "row", col, {r6_sql('sum(3 * w)')} as val from (
 select p_partkey, w, ({_slot("'p_brand:p_type'", 'p_brand', '100 + p')} + {_slot("'p_brand:p_type'", 'p_type', '100 + p')}) % 5000 as col
 from rows, (select unnest([0, 1]) as p)) group by all""")
def hash_interaction(t: Tables) -> DataFrame:
    brands = t.part.where("p_size <= 25").groupBy(F.col("p_brand").alias("word")).agg((1 + F.count(F.lit(1)) / 1000).alias("weight"))
    types = t.part.where("p_size > 25").groupBy(F.col("p_type").alias("word")).agg((2 + F.min("p_size") / 10).alias("weight"))
    coded = encode.encode_interaction(t.part, "p_partkey", "p_brand", "p_type", weight=3.0, a_weights=brands, b_weights=types)
    return coded.withColumn("val", r6("val"))


@query("hash_trace", f"""select distinct field, value, {_slot('field', 'value', '100 + p')} as slot from (
 select 'p_brand' as field, p_brand as value from part union select 'p_type', p_type from part), (select unnest([0, 1]) as p)""")
def hash_trace(t: Tables) -> DataFrame:
    return encode.trace(t.part, ["p_brand", "p_type"])


@query("intern", """select value, row_number() over (order by f, value) - 1 as id from (
 select p_name as value, min(p_partkey) as f from part group by 1)""")
def intern(t: Tables) -> DataFrame:
    return encode.intern(t.part, "p_name", "p_partkey")
