"""The training-data queries with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.exact_dedup import exact_dedup
from tributary.llm.folds import fold
from tributary.llm.language_id import identify
from tributary.llm.mixing import mix_report
from tributary.llm.ngram_join import ngram_join
from tributary.llm.order_minhash import edit_report
from tributary.llm.sentencepiece_codec import encode_digests
from tributary.llm.suffix_dedup import suffix_digests
from tributary.llm.token_counts import token_counts
from tributary.llm.token_store import token_round_trip
from tributary.llm.toxicity import fit, score_documents


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join(_documents(spark, sf))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = _documents(spark, sf), fold(F.col("doc_id"), 5) == 0
    return score_documents(docs, fit(docs, _labels(spark, sf).where(~held_out)), held_out)


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return identify(_documents(spark, sf), fold(F.col("doc_id"), 3) == 1)


def op4_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return edit_report(_documents(spark, sf))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf), verify_texts=True)


def op6_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encode_digests(_documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


#: The labelled table's domains as SQL, and what share of the tokens each is to have.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 1 then 'clean' when quality = 0 then 'poor' end"
WEIGHTS = {"clean": 0.7, "poor": 0.2, "toxic": 0.1}


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(_documents(spark, sf), _labels(spark, sf), F.expr(DOMAIN), WEIGHTS)


def op8_token_store(spark: SparkSession, sf: str) -> DataFrame:
    return token_round_trip(_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_digests(_documents(spark, sf))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_order_minhash": op4_order_minhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_mixing": op7_mixing,
    "op8_token_store": op8_token_store,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingles, links and their closure.
_NGRAM_JOIN = f"""with recursive t as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end g from t),
u as (select doc_id, len(g) n, unnest(g) k from s),
p as (select a.doc_id a, b.doc_id b, any_value(a.n) x, any_value(b.n) y, count(*) c from u a join u b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p where 100 * c >= 75 * (x + y - c)),
l as (select a, b from e union all select b, a from e),
r(d, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join l on r.d = l.a)
select s.doc_id, cast(len(g) as bigint) n_shingles, m.c component_id from s join (select d, min(c) c from r group by d) m on m.d = s.doc_id"""

#: Windows of 400 bytes as hexadecimal text, those that occur twice, their union, and what is left.
_SUFFIX_DEDUP = """with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) m from (select doc_id, h, unnest(range(0, len(h) // 2 - 399)) i from t)),
d as (select m from w group by m having count(*) > 1),
g as (select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) p from w semi join d using (m)),
v as (select doc_id, i, sum(case when p is null or i > p + 400 then 1 else 0 end) over (partition by doc_id order by i) k from g),
x as (select doc_id, k, min(i) a, max(i) + 400 b from v group by 1, 2),
y as (select doc_id, list(a order by a) a, list(b order by a) b, sum(b - a) n from x group by 1)
select t.doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed, cast(coalesce(len(a), 0) as bigint) n_spans,
  sha256(unhex(case when n is null then h else array_to_string([substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1])) for z in list_zip(list_prepend(0, b), list_append(a, len(h) // 2))], '') end)) kept_sha256
from t left join y using (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_ngram_join": _NGRAM_JOIN,
    "op9_suffix_dedup": _SUFFIX_DEDUP,
    "op5_exact_dedup": f"""with h as (select doc_id, sha256({_LOWER}) text_sha256 from documents)
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, text_sha256
from h window g as (partition by text_sha256)""",
}
