"""The training-data pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.llm import line_dedup, mixing, setsketch, toxicity
from figmill.llm.common import scratch_root
from figmill.llm.packing import pack
from figmill.llm.queries import table, tokenizer_path

#: Columns of ``documents``, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; no text is moved for it.

    Null and empty texts are judged like their like among the examples, repeated rows each; without labels nothing goes.
    """
    model, _ = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(COLUMNS).filter(~model.rejects(F.col("doc_id"), F.col("text")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, and the documents that have nothing else; n_chars follows the text."""
    clean = line_dedup.clean(docs.select(COLUMNS), short=True)
    gone = F.col("n_repeated") + F.col("n_near")
    # a text that is empty from the start stays
    left = clean.filter((gone == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, similarity 0.8 or more) one document stays.

    Of repeated rows one stays, of a group the smallest doc_id; texts without words, null ones too, all stay.
    """
    return setsketch.deduplicate(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets want them, at most three times.

    A null source is a source; texts without words are taken once; rows alike share their copies evenly.
    """
    return mixing.mix(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids, their places in the sequences, and the row each comes from: copies that mixing made are rows of their own.

    Null and empty texts are one piece with the end id alone; an empty table gives no rows.
    """
    return pack(docs.select(COLUMNS), tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Nearest examples, registers and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, through Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark)}/figmill/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(out)
        docs = spark.read.parquet(out)
    return docs
