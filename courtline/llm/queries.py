"""Registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtline.llm.byte_pairs import encoded_digests, read_ranks
from courtline.llm.centroids import centroid_clusters
from courtline.llm.collocations import collocations
from courtline.llm.common import table
from courtline.llm.cotraining import classify
from courtline.llm.decontamination import decontaminate
from courtline.llm.html_text import main_text
from courtline.llm.language_id import language_id
from courtline.llm.licenses import scan_licenses
from courtline.llm.mixing import mixing_rates
from courtline.llm.near_duplicates import near_duplicates
from courtline.llm.quality_rules import quality_rules
from courtline.llm.secrets import scan_secrets
from courtline.llm.sql import SQL  # noqa: F401 - part of this module's interface
from courtline.llm.substring_dedup import dedup_substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


@query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


@query
def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the vocabulary files; no other query needs them

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("first_doc")


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))
