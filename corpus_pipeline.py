"""Corpus cleaning pipeline over documents: STAGES in order, each over what its predecessor kept.

Every stage but the last returns the columns of documents. Nulls: a document without a text or without a letter is
rejected by the first stage; a null doc_id, lang, source or n_chars is kept as it is. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import cut
from millrace.llm.language import UNKNOWN, predict, train
from millrace.llm.near_copies import near_copies
from millrace.llm.packing import pack
from millrace.llm.repeated_passages import remove_repeated
from millrace.llm.secrets import scan_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least mean probability of a document's language; a text of one known language is far above it.
SURE = 0.3
#: What stands for a secret that was taken out.
MARK = "[SECRET]"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised."""
    docs = docs.select(*COLUMNS)
    labelled = predict(docs, train(docs), keep=COLUMNS)
    return labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of every class of near copies the document with the least id (and of those the least text digest), once."""
    docs = docs.select(*COLUMNS).withColumn("key of", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    stay = cut(near_copies(docs, keep_first=True).filter("is_first").groupBy("doc_id", "key").agg(F.count("*").alias("rows")))
    kept = docs.join(stay.select(F.col("doc_id").alias("id of"), "key"), F.col("doc_id").eqNullSafe(F.col("id of")) & (F.col("key of") == F.col("key")), "left_semi").select(*COLUMNS)
    return kept if stay.filter("rows > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that occur elsewhere; a document of which nothing is left goes."""
    found = remove_repeated(docs, keep=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.filter("n_words > n_removed").withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; all documents stay."""
    found = scan_secrets(docs, redact=MARK, keep=COLUMNS)
    changed = F.size("spans") > 0
    text = F.when(changed, F.col("redacted")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, with their ids and their places in training sequences."""
    return pack(docs, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("passages", passage_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Language models, shingle sets and byte-pair merges have no SQL form; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of documents; what each stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
