"""From raw documents to token ids: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Each result is written as Parquet and read again as the next one's
docs.

Nulls and empty texts: a null or empty text has no language and goes in the first stage; an
empty table gives an empty one throughout, and without a labelled row no language is known, so
nothing stays.  Rows are judged as rows, by id and text: texts under one id, or under null,
live or die on their own.  Of near copies the smallest id stays, a null id last, and of rows
that repeat id and text one.  Very long texts are taken whole.  Extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, decontaminate, langid, suffix
from tesserae.llm.jaccard import without_near_copies
from tesserae.llm.storage import delete, owned, shared_dir
from tesserae.llm.vocabulary import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found, learned from those that name theirs."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    return langid.identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: 5-word shingles, Jaccard 0.8."""
    return without_near_copies(docs, size=5, threshold=(80, 100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes and more that stand earlier in the corpus out of the texts."""
    out = suffix.without_repeats(docs, width=100)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts; decode again, and give digests of both."""
    out = bpe.round_trip(docs, vocabulary_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Language identification is beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables.

    A stage's own tables go when its result is written, and that result when the next one's is;
    the last result stays, for the caller to read and delete.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with owned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
