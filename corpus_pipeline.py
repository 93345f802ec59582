"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import made, release, stash, tidy
from geoloom.llm.queries import PIECE_MODEL, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored under one half go."""
    from geoloom.llm.bytecnn import classify, fit

    net = fit(docs, read(spark, sf_dir, "labels"), fold=1, folds=3)
    return classify(docs, net, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup at five words and a similarity of 0.8: one of each group stays."""
    from geoloom.llm.nearcopies import keep_one

    return keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    from geoloom.llm.decontaminate import annotate

    found = annotate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: found secrets are masked in the text; every document stays."""
    from geoloom.llm.secrets import mask_documents

    return mask_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: token ids, their count and the digests of ids and decoded text."""
    from geoloom.llm.pieces import encode_documents

    return encode_documents(docs, PIECE_MODEL, keep=("doc_id", "lang", "source"), ids=True).drop("decoded")


STAGES = [
    ("quality classifier", tidy(quality)),
    ("SimHash near-dedup", tidy(near_copies)),
    ("benchmark decontamination", tidy(decontaminate)),
    ("secret scans", tidy(mask_secrets)),
    ("SentencePiece encoding and decoding", tidy(encode)),
]

#: Stages are trained or iterative; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is the next one's input."""
    mark = made()
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = release(mark, stash(docs, f"stage{i}"))
    return docs
