"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being all rows its predecessor kept, and all but the last return the columns
of documents. run() writes each stage's rows to the shared folder and reads them back as the next one's docs.

Near-dedup takes five-word shingles and links texts of similarity 0.8 or more; the smallest doc_id of each group stays. Mixing weighs sources 3, 1, 2 and takes 150 % of the words; a document taken twice is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import exact_dedup, mixing, quality, queries, simhash
from tracewright.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, weights=[3, 1, 2], budget_percent=150, max_epochs=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs.select("doc_id", "text"))


STAGES = [("quality classifier", classify), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: A trained scorer, SimHash components and byte-pair ids cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
