"""The cleaning pipeline over ``documents``: STAGES in order, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.functions.storage import ship
from lineagelake.llm.common import stored
from lineagelake.llm.decontaminate import drop_contaminated
from lineagelake.llm.near_dedup import near_duplicates
from lineagelake.llm.packing import pack
from lineagelake.llm.pii import redact
from lineagelake.llm.queries import tokenizer_path
from lineagelake.llm.toxicity import drop_toxic

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.  Null and empty texts are scored by the
    intercept; repeated rows go or stay together; without labels all stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, 0.8).  Null and
    blank texts and rows without doc_id have no copies and stay; rows that repeat a doc_id are
    one document and stay together."""
    copies = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go.  Null and empty texts hold none; repeated rows go
    or stay together."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*_COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks; ``n_chars`` follows.  Null texts stay null; no row
    goes."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens.  Null and empty texts
    are the end id alone; repeated rows are packed as often as they occur."""
    return pack(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]
#: Scores, signatures and token ids are beyond SQL.  The tests hold the copies and benchmark
#: stages against comparisons of all pairs and windows, and the others against planted cases.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``.  An empty table gives
    no row; other columns than those of ``documents`` are left out."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
