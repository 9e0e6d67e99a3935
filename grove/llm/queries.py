"""The subpackage's queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .conversations import ORACLE as OP12_SQL
from .conversations import prefix_trie
from .decontamination import ORACLE as OP1_SQL
from .decontamination import find_contamination, matches_as_text
from .html import extract_pages
from .licenses import notices_as_text, scan_licenses
from .lm import score_texts
from .mixing import mix_sources
from .pii import detect_pii, pii_digest
from .quality import score_quality
from .resampling import ORACLE as OP13_SQL
from .resampling import resample
from .rules import apply_rules
from .simhash import near_duplicates
from .toxicity import score_toxicity
from .warc import ORACLE as OP11_SQL
from .warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches_as_text(find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), rescannable=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(detect_pii(read_table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), rescannable=True)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices_as_text(scan_licenses(read_table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_lm, op3_simhash, op4_html, op5_mixing, op6_pii, op7_quality, op8_rules, op9_licenses, op10_toxicity, op11_warc, op12_prefix_trie, op13_resampling)}

ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op11_warc": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_resampling": OP13_SQL}
