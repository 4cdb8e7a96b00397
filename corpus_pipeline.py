"""From raw documents to encoded training text, stage by stage.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Null and empty texts are scored like any other by the classifier; null texts are no copies of one another, empty ones are. Null ids are
kept, repeated rows are copies. An empty table passes through as an empty one. Columns of docs beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import mixing, neardup, pieces, pii, quality
from tidewater.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, trained on the labels, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.learnable)
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, also where ids are null or repeat."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced; n_chars follows."""
    cleaned = pii.sanitise(docs).select("doc_id", F.col("pii_text").alias("text"), "lang", "source", "n_chars")
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal expected shares, in random order; a document comes as often as its Poisson draw says."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it again; the text goes."""
    return pieces.encoded(docs).select("doc_id", "lang", "source", "n_chars", "n_pieces", "piece_ids", "round_trip")


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixture", mix_sources),
    ("pieces", encode),
]

#: Trained and sketched stages have no SQL; tests hold each stage against a plain version of what it should do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
