"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's
result is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wealthspark.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from wealthspark.llm.queries import vocabulary_path
from wealthspark.llm.shared import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more. The model learns from labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out("doc_id"))
    return quality.accepted(spark, docs, quality.train(docs, labels))


def _rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, doc): the documents with a number for each row, stored so that all who read it see the same numbers."""
    return written(spark, docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal after lower-casing A-Z, the one with the largest id.

    Each row is judged by itself: of rows with one text and one id a single one stays, and different texts under one id are different
    documents. A null id is below all others.
    """
    rows = _rows(spark, docs)
    judged = exact_dedup.exact_duplicates(rows.select(F.struct("doc.doc_id", "row").alias("key"), "doc.text"), id="key")
    return rows.join(judged.filter("kept").select("key.row"), "row", "left_semi").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest id.

    Each row is judged by itself: of linked rows with one id a single one stays, and different texts under one id are different documents.
    Rows with a null id are linked with nothing and stay.
    """
    rows = _rows(spark, docs)
    named = rows.filter("doc.doc_id IS NOT NULL").select("row", "doc.doc_id", "doc.text")
    judged = near_dedup.near_duplicates(spark, named, k=5, percent=80, id="row").select("row", "component_id")
    first = named.select("row", "doc_id").join(judged, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    kept = first.select("first.row").union(rows.filter("doc.doc_id IS NULL").select("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence of 2048 tokens."""
    return packing.pack(spark, docs, vocabulary_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: The classifier's scores, the tokens and the packing have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for _, stage in stages:
        docs = written(spark, stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
