"""A training corpus from raw documents, in five stages.

Quality classifier, SimHash near-dedup, benchmark decontamination, personal
data, mixing of sources. Each stage works on what the one before kept, which
run() writes as Parquet and reads again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.common import read_table, stored
from grove.llm.decontamination import find_contamination
from grove.llm.mixing import mix_sources
from grove.llm.pii import detect_pii
from grove.llm.quality import score_quality
from grove.llm.simhash import near_duplicates


OWN = ("doc_id", "text")


def hidden(docs: DataFrame) -> DataFrame:
    """docs with all but the id and the text under names that no operator uses."""
    return docs.select(*[F.col(c).alias(c if c in OWN else f"_column{i}") for i, c in enumerate(docs.columns)])


def shown(docs: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns by their own names again, and more."""
    return docs.select(*[F.col(c if c in OWN else f"_column{i}").alias(c) for i, c in enumerate(columns)], *more)


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs, hidden, with a key for each row: ids may be null or repeat, so stages decide by row.

    The key is the row's file and its place in it, which every reading finds
    again however files are split. What isn't read from files is written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs, f"pipeline-{name}-rows")
    row = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), "_metadata.row_index")
    return docs.select(*[F.col(c).alias(c if c in OWN else f"_column{i}") for i, c in enumerate(docs.columns)], row.alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field calls bad go."""
    own = hidden(docs)
    scored = score_quality(own, read_table(spark, sf_dir, "labels"), keep=tuple(own.columns))
    return shown(scored.where(F.col("predicted") == 1), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest id stays, one without an id only where all lack it; of rows that repeat that id, one."""
    own = keyed(docs, "dedup")
    found = near_duplicates(own, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    first = found.join(own.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(place)["_row"].alias("_row"))
    return shown(own.join(stored(first.select("_row"), "pipeline-firsts").hint("shuffle_hash"), "_row", "left_semi"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more stands in the benchmark go."""
    own = keyed(docs, "contamination")
    found = find_contamination(own, read_table(spark, sf_dir, "benchmark"), id_col="_row")
    hit = stored(found.where("contaminated").select(F.col("doc_id").alias("_row")), "pipeline-contaminated")
    return shown(own.join(hit, "_row", "left_anti"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows the text."""
    own = hidden(docs)
    found = shown(detect_pii(own, keep=tuple(own.columns), redacted="text"), docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with their size in words, their source's target, and their number of copies, in place of columns of these names."""
    added = ("size", "target", "copies")
    docs = docs.drop(*added)
    own = keyed(docs, "mix")
    mixed = mix_sources(own, source_col=f"_column{docs.columns.index('source')}", row_col="_row").where("copies > 0").select("_row", *added)
    return shown(own.join(mixed.hint("shuffle_hash"), "_row"), docs.columns, *added)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("PII", personal_data), ("mixing sources to target weights", mixing)]

#: SQL can't express the stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
