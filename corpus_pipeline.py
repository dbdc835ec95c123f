"""A training corpus from a table of documents: clean, dedup, mix and pack.

Each stage reads all that its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, prepare
from millrace.llm.exact_dedup import ExactDedup
from millrace.llm.line_rules import apply_line_rules
from millrace.llm.mixing import poisson_mix
from millrace.llm.packing import pack
from millrace.llm.signature_join import similar_components
from millrace.operators.components import small
from millrace.session import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Best-fit packing is sequential and near copies form connected components: no SQL yardstick.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their failing lines; rejected documents go.

    Null and empty texts fail the base rules and go; rows that repeat an id are judged each; further columns go.
    """
    prepare(spark)
    kept = apply_line_rules(docs).filter("kept").withColumn("text", F.col("cleaned_text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id.

    A null text is an empty one, a null id ranks lowest; of rows that repeat id and text one stays.
    """
    prepare(spark)
    return ExactDedup(docs).survivors().select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id.

    Texts without words and rows without an id stay; rows that repeat an id stay or go together.
    """
    prepare(spark)
    found = similar_components(docs, n=5, percent=80).filter("component_id <> doc_id").select("doc_id").distinct()
    # Written down first, so that the join is planned by its real size.
    gone = Workspace(spark).materialize(found, "near-copies")
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources nearer to equal mass; a document can go or come several times.

    A null source is a source of its own; rows that repeat an id draw the same count; an empty table stays empty.
    """
    prepare(spark)
    return poisson_mix(docs).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every row; copies of a document never share a bin.

    A null text is an empty one, without pieces that take room; ties go to the first bin; repeated rows are packed each.
    """
    prepare(spark)
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("source mixing", mix_sources),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    space = Workspace(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = space.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
