"""The registered queries of this subpackage, each over its whole table.

What each gives for null and empty texts, repeated rows and ids, ties and empty tables is
said where its operator is defined; columns besides those named there are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, decontaminate, embedding, langid, pii, quality, records, repair, simhash, substring, topk
from .common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.render(chat.fold_events(chat.from_turns(turns.unionByName(more)))))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.components(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digest(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "conversations"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.failing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def queries() -> dict:
    every = (op1_chat, op2_simhash, op3_decontamination, op4_pii, op5_bpe, op6_quality, op7_records, op8_langid, op9_embedding, op10_substring, op11_repair, op12_topk, op13_audit)
    return {f.__name__: f for f in every}


OP1_SQL = r"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from turns),
e as (select *,
  replace(replace(replace(replace(replace(role, '\', '\e'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]') as erole,
  replace(replace(replace(replace(replace(text, '\', '\e'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]') as etext
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(10 + length(erole) + 9 + length(etext) + 4) as bigint) as formatted_chars
from e group by conv_id"""

OP12_SQL = """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
e as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as term from v),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from e q join e c on q.term = c.term and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by 1, 2)
select query_id, cast(row_number() over w as int) as rank, vec_id, score from scores
window w as (partition by query_id order by score desc, vec_id) qualify rank <= 20"""

OP13_SQL = r"""
with recursive words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
first as (select coalesce(text, '') as text, min(doc_id) as least from documents group by 1),
flags as (
  select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
    (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) then 4 else 0 end)
    + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > least then 16 else 0 end) as failed
  from words join first using (text) left join labels using (doc_id)),
counts as (select part, failed, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from flags group by 1, 2),
orders as (
  select '' as o union all
  select o || l from orders join (select unnest(['A', 'B', 'C', 'D', 'E']) as l) on instr(o, l) = 0),
steps as (
  select o as filter_order, cast(step as int) as step, 1 << (ascii(o[step]) - 65) as own,
    cast(coalesce(list_sum([1 << (ascii(o[k]) - 65) for k in range(1, step)]), 0) as bigint) as before
  from orders, range(1, 6) as r(step) where length(o) = 5)
select part, filter_order, step,
  cast(sum(case when failed & (before | own) = 0 then n else 0 end) as bigint) as kept,
  cast(sum(case when failed & own <> 0 and failed & before = 0 then n else 0 end) as bigint) as removed,
  cast(sum(case when failed & own <> 0 and failed & before <> 0 then n else 0 end) as bigint) as redundant,
  cast(sum(case when failed = own then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when failed & own <> 0 and failed & before = 0 then good else 0 end) as bigint) as good_lost,
  cast(sum(case when failed & own <> 0 and failed & before = 0 then toxic else 0 end) as bigint) as toxic_lost,
  cast(sum(case when failed & own <> 0 then n * (120 // bit_count(failed)) else 0 end) as bigint) as shapley
from counts, steps group by 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op12_topk": OP12_SQL, "op13_audit": OP13_SQL}
