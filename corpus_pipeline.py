"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns of
documents; the last returns the token digests of what is left. Null and empty texts are kept by the filters (one of them:
they are equal); an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bytebpe, decontaminate, order_minhash, pii, toxicity
from millrace.llm.common import delete, packed, scratch, table, unpacked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go. The classifier learns from the labelled rows of docs."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), model).filter("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest doc_id stays."""
    return order_minhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become <KIND>; n_chars follows the text."""
    out = unpacked(pii.redact(pii.find(packed(docs), out="_pii"), spans="_pii"), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bytebpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("byte_bpe", encode),
]

#: Not expressible in SQL: a fitted classifier, alignment, and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's result written as Parquet in the shared folder and read again; a result is
    deleted once the next one is written. That of the stage before the last stays, as the returned rows are read from it."""
    docs, at, before = table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete(spark, f"{at}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
