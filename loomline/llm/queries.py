"""The operators as queries over their whole tables, with their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, linededup, mixing, packing, quality, simhash, token_counts, topk, toxicity
from .common import cut, read, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fitted(docs, read(spark, sf_dir, "labels")))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fitted(docs, read(spark, sf_dir, "labels")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def line_dedup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 keeps its state with: half the documents inserted, then the others, then a third deleted; the lines that each document left is the first owner of."""
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/line-dedup-{uuid.uuid4().hex}"
    state = linededup.LineDedup(spark, at, linededup.shards_for(docs))
    for odd in (0, 1):
        state.insert(docs.where(F.col("doc_id") % 2 == odd))
    state.delete(docs.where("doc_id % 3 = 0").select("doc_id"))
    owned = state.table("counts").groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("first_lines"), F.sum("refs").alias("occurrences"))
    owned = cut(owned)
    state._fs().delete(state._hadoop(at), True)
    return owned


_ALL = (op1_token_counts, op2_toxicity, op3_topk_search, op4_source_mixing, op5_language_id, op6_quality_rules, op7_simhash_dedup, op8_packing, op9_line_dedup, op10_chat_format, line_dedup_incremental)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

LINE_DEDUP_SQL = r"""
with split as (select doc_id, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(0, len(lines))) as pos from split),
t as (select *, trim(line, ' ' || chr(9) || chr(13)) as bare from l),
k as (select *, bare = '' or row_number() over (partition by bare order by doc_id, pos) = 1 as stays from t),
g as (select doc_id, string_agg(line, chr(10) order by pos) filter (where stays) as text, count(*) filter (where not stays) as n from k group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(g.text, '') end as text, d.lang, d.source, d.n_chars, coalesce(g.n, 0)::BIGINT as lines_removed
from documents d left join g using (doc_id)"""

INCREMENTAL_SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where doc_id % 3 <> 0),
k as (select trim(line, ' ' || chr(9) || chr(13)) as bare, min(doc_id) as doc_id, count(*) as n from l group by 1)
select doc_id, count(*)::BIGINT as first_lines, sum(n)::BIGINT as occurrences from k where bare <> '' group by doc_id"""

ORACLE_SQL: dict[str, str] = {"op3_topk_search": topk.TOP_K_SQL, "op10_chat_format": chat.CHAT_SQL, "op4_source_mixing": mixing.replicate_sql(), "op9_line_dedup": LINE_DEDUP_SQL, "line_dedup_incremental": INCREMENTAL_SQL}
