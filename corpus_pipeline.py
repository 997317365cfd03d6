"""A corpus pipeline of five stages: toxicity, quality, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm import decontaminate, knn_quality, pivotal_mix, simhash_similar, toxicity
from keystrand.llm.common import cut, read_table
from keystrand.llm.entry import PREDICT_AT, quality_model, toxicity_grammar

TEXT, ROW = "_text", "_row"


def _packed(docs: DataFrame) -> DataFrame:
    """(_row, _text): the documents' columns out of the way of any column of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), F.col("text").alias(TEXT))


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    grammar = toxicity_grammar(spark, sf_dir, docs)
    return _unpacked(toxicity.score(_packed(docs), grammar, TEXT).where(F.col("score") < PREDICT_AT))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the threshold go."""
    model = quality_model(spark, sf_dir, docs)
    return _unpacked(knn_quality.score(_packed(docs), model, TEXT).where(F.col("score") >= PREDICT_AT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with five-word shingle similarity of 0.8 or more stays."""
    return simhash_similar.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    scanned = decontaminate.scan(_packed(docs), read_table(spark, sf_dir, "benchmark"), text_col=TEXT)
    return _unpacked(scanned.where(F.size("hit_positions") == 0))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies to take of each."""
    return pivotal_mix.take(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
]

#: SQL has no learned grammar, SimHash or pivotal rounding; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
