"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from mutalog.llm import ann, bpe, chat, mixing, quality, sharding, simhash, suffix_dedup, token_counts
from mutalog.llm import exact_dedup as exact
from mutalog.llm.shared import text_of

SHARDS = 40


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p", 6).alias("p"), "kept")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ann.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return ann.search(ann.index(points), points.where("vec_id % 100 = 0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir, "doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir, "doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    made = quality.scored(docs, model)
    return made.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"), keep_text=True)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("removed"), (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"), "kept_text")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    rows = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(rows, ["doc_id", "text_crc32"], ["size"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -7L as conv_id, 0L as turn, 'user' as role, '</s>[INST] ok [/INST]' as text union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    made = chat.conversations(chat.as_messages(turns.unionByName(extra)), unique=True)
    read = made.select("tree_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir, "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_ann, op3_simhash, op4_exact_dedup, op5_bpe, op6_quality, op7_suffix_dedup, op8_sharding, op9_chat, op10_token_counts)
} | {"pipeline": corpus_pipeline.run}


def _mixing_sql(temperature: float = 0.7, rate: float = 0.5, sweeps: int = 32, seed: int = 7) -> str:
    """The same raking, written out sweep by sweep; so many leave deviations far below what is rounded away."""
    topic = "case " + " ".join(f"when {' or '.join(f'contains(t, {chr(39)}{m}{chr(39)})' for m in marks)} then '{name}'" for name, marks in mixing.TOPICS.items()) + " else 'prose' end"
    out = f"""with rows_ as (select doc_id, source, lang, {topic} as topic, cast(len(regexp_extract_all(t, '\\p{{L}}+|\\p{{N}}+|[^ \\t\\n\\v\\f\\r\\p{{L}}\\p{{N}}]+')) as bigint) as n_tokens
  from (select *, coalesce(text, '') as t from documents) x),
c0 as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from rows_ group by all),
w0 as (select *, tokens as w, sum(tokens) over () as total"""
    for m in mixing.MARGINS:
        out += f", pow(sum(tokens) over (partition by {m}), {temperature}) / (select sum(pow(x, {temperature})) from (select sum(tokens) as x from c0 group by {m})) as t_{m}"
    out += " from c0)"
    k = 0
    for _ in range(sweeps):
        for m in mixing.MARGINS:
            out += f",\nw{k + 1} as (select source, lang, topic, tokens, total, t_source, t_lang, t_topic, case when sum(w) over (partition by {m}) > 0 then w * t_{m} * total / sum(w) over (partition by {m}) else 0 end as w from w{k})"
            k += 1
    return (
        out
        + f""",
f as (select *, case when tokens > 0 then w / tokens else 0 end as f from w{k}),
g as (select *, ({rate} * total - coalesce(sum(tokens) over (order by f desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0))
  / nullif(sum(w) over (order by f desc, source, lang, topic rows between current row and unbounded following), 0) as c from f),
h as (select *, max(case when c * f <= 1 and c >= 0 then c end) over () as best from g),
p as (select source, lang, topic, case when tokens > 0 then case when best is null then 1.0 else least(1.0, best * f) end else 1.0 end as p from h)
select doc_id, r.source, r.lang, r.topic, n_tokens, round(p, 6) as p,
  cast(('0x' || substr(md5(doc_id || ':{seed}'), 1, 12)) as bigint) / 281474976710656.0 < p as kept
from rows_ r join p on r.source is not distinct from p.source and r.lang is not distinct from p.lang and r.topic = p.topic"""
    )


_NORMALISED = "regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')"

ORACLES: dict[str, str] = {
    "op1_mixing": _mixing_sql(),
    "op4_exact_dedup": f"""with n as (select doc_id, {_NORMALISED} as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n""",
    "op9_chat": """with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, replace(replace(replace(replace(replace(replace(replace(replace(x, '~', '~0'), '<|', '~1'), '</s>', '~2'), '<s>', '~3'), '[INST]', '~4'), '[/INST]', '~5'), '<<SYS>>', '~6'), '<</SYS>>', '~7') as said
  from (select *, text as x from c) y)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length(said) + length(role) + 17) as bigint) as formatted_chars
from e group by conv_id""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
