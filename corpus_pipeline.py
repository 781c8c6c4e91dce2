"""Documents to training text: toxicity, near duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; run() writes each stage's rows as Parquet and reads them again.
All but the last return the columns of docs, whatever these are besides doc_id, text and source.

Stages judge rows, not ids: rows that repeat share their fate, and a row without an id is judged by its text. A null or empty text is neither toxic nor a copy nor
contaminated, and stays as it is. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import minhash, mixing, pii, tiling, toxicity
from hearthline.llm.storage import discard, free_name, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below 0.7, labels learnt as in op6."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn_from_labels(docs, labels)
    return docs.where(toxicity.score_column(lexicon)(F.col("text").cast("string")) < 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by a similarity of 0.8 or more of its five-word shingles. Rows without an id come after all ids, in an order of their texts' hashes."""
    key, gone = free_name(docs, "key"), free_name(docs, "gone")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    out = minhash.near_duplicates(docs.select(own.alias(key), "text"), id_col=key, per_cent=80, rows=5, bands=32)
    return docs.join(out.where("NOT kept").select(F.col(key).alias(gone)).distinct(), own == F.col(gone), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return tiling.clean(docs, benchmark, cover=0.5, least=4)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind's name in brackets. A column n_chars follows the new text."""
    model = pii.fit(docs)
    names = docs.columns
    out = pii.redact_column(docs, model, "text")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with the columns of docs and copy, from 1. Documents taken 0 times go."""
    return mixing.repeat(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact),
    ("mixing", mix_sources),
]

#: Learnt scores, similarity links and tilings are not for SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return docs
