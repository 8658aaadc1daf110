"""A corpus pipeline: each stage reads what its predecessor kept, and its decisions take effect.

Stages take (spark, docs, sf_dir); all but the last return the columns of ``documents``. The steps
in between are written as Parquet in the shared folder of the session and read again.

All stages alike: each row is decided by itself, repeated ids and rows too; null ids are kept; other
columns than those of ``documents`` are dropped, so their names never clash; an empty table gives an
empty one; texts are whole, however long. What else is defined for odd rows is stated with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, language_id, packing, pii
from gridloom.llm.samples import fold
from gridloom.llm.shared import small_batches, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (``und``: null and empty ones too), and no others; fills in missing languages.

    Where no row has a language to learn from, every text is ``und`` and goes.
    """
    small_batches(spark)
    model = language_id.fit(docs, fold("doc_id", 4) != 2)
    found = language_id.identify(docs, model, *COLUMNS).where(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked texts: the one with the smallest id (rows without an id come last).

    Rows are numbered first and linked by their numbers, so that rows that share an id are decided
    by their own texts, and of equal rows one stays. Null, empty and blank texts link with nothing and stay.
    """
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = jaccard_join.ngram_jaccard_join(rows.select(F.col("row").alias("doc_id"), "text"), k=4, percent=85)
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(kept.select("first.row"), "row", "left_semi").select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up 5 % of all words or more; texts without words stay."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), *COLUMNS[1:], span=13, percent=5)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``[KIND]`` in the place of personal data; no document goes, and a null text stays null."""
    found = pii.detect(docs, pii.fit(docs), "lang", "source", redact=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 2048; a null or empty text is its end id alone."""
    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), mode="spaces", end_id=0, size=2048, with_ids=False)
    return packing.place(pieces, size=2048)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The trained model and the tokenizer are beyond SQL; a brute-force version checks the pipeline in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
