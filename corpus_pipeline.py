"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, as they are to go on.
Every stage but the last returns the columns of ``documents``; the last adds the mixing rate.
A model decides the first stage and the last, so there is no SQL for the rows of ``run``; the
tests hold it against a brute-force version.

Columns of the input, whatever their names, are packed away while an operator works and come
back as they were; only the secrets stage changes text and n_chars. The last stage adds
``n_tokens`` and ``rate``; where the input has a column of that name, the input's keeps it and
the stage's gets an underscore in front.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm.common import table
from courtline.llm.decontamination import decontaminate
from courtline.llm.language_id import identified
from courtline.llm.mixing import mixed
from courtline.llm.near_duplicates import near_duplicates
from courtline.llm.secrets import redact
from courtline.session import ensure_checkpoint_dir

ORACLE_SQL = None
#: A prediction under this score is rejected, as is a text without a language. A text in two known
#: languages scores about a half, and is as clean as others.
MIN_LANGUAGE_SCORE = 0.3


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator works on, and beside them the whole row as ``row``."""
    return docs.select(*used, F.struct(*_columns(docs)).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language. No shuffle: the prediction stands beside the row."""
    told = identified(_packed(docs, "doc_id", "text", "lang"))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8."""
    kept = near_duplicates(docs, shingle=5, percent=80).filter("kept and doc_id is not null")
    named = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(_columns(docs)).union(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    leaks = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    changed = [c for c in ("text", "n_chars") if c in docs.columns]
    clean = redact(_packed(docs, "doc_id", *changed))
    for c in changed:
        clean = clean.withColumn("row", F.col("row").withField(c, F.col(c)))
    return clean.select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their sampling rate; those of rate zero leave the mix."""
    out = mixed(_packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels")).filter("rate > 0")
    return out.select("row.*", *(F.col(c).alias(_free(c, docs.columns)) for c in ("n_tokens", "rate")))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing to target weights", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result in the shared folder before the next begins."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
