"""The registered queries of this subpackage, each a thin use of one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import alignment, licences, minhash, mixing, pii, quality, recompress, spelling, tiling, tokens, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(_table(spark, sf_dir, "pages"), least=100)
    return warc.read_bundles(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = pii.find(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), per_cent=85)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), windows=True)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), cut=0.7)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), cover=0.5, least=4)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompress.remove_repeats(_table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), cut=0.3)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licences, op2_tokens, op3_warc, op4_pii, op5_minhash, op6_toxicity, op7_decontamination, op8_mixing, op9_substring, op10_topk, op11_quality, op12_spelling, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": licences.oracle(), "op3_warc": warc.ORACLE, "op5_minhash": minhash.ORACLE, "op8_mixing": mixing.ORACLE, "op9_substring": recompress.ORACLE, "op10_topk": topk.ORACLE, "op12_spelling": spelling.ORACLE}
