"""The registered queries of this sub-package, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

#: Local path, on every executor, of the public piece vocabulary.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: Rows of an Arrow batch where the session sets none: texts may be long.
BATCH_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    out = components(read(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaked

    return leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, fit

    docs = read(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, read(spark, sf_dir, "labels"), fold=0, folds=5))
    return scored.select("doc_id", _fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    odd = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), odd.alias("text"))
    events = chat.streamed(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    return chat.digest(chat.read_back(chat.render(chat.reconstruct(events))))


def _fold(folds: int, fold: int):  # noqa: ANN202
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytecnn import classify, fit

    docs = read(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, read(spark, sf_dir, "labels"), fold=1, folds=3))
    return scored.select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _fold(7, 2))
    return score_documents(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.93)


OPERATORS = (op1_sentencepiece, op2_simhash, op3_decontaminate, op4_secrets, op5_toxicity, op6_repeats, op7_chat, op8_quality, op9_lm, op10_embeddings)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {run.__name__: tidy(run) for run in OPERATORS}

ORACLE_SQL: dict[str, str] = {
    "op10_embeddings": """
with recursive e as (select vec_id, label, embedding::double[] v from embeddings where label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  and list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) n from links group by a), c as (select a, min(b) b from reach group by a)
select vec_id, coalesce(n.n, 0) n_links, least(vec_id, coalesce(c.b, vec_id)) component_id, vec_id <= coalesce(c.b, vec_id) kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id""",
    "op7_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
r as (select *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) body, case when role in ('system', 'user', 'assistant') then length(role)
  else 1 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) end head from c),
g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn) turns,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '') loss, cast(sum(4 + head + 2 + body + 8) as bigint) formatted_chars from r group by conv_id)
select conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, formatted_chars from g""",
}
