"""The training-data queries: ``pN_...`` of each problem N, over whole tables with production parameters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, whose texts a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import pairs

    _batches(spark)
    sft = _table(spark, sf_dir, "sft_train").select("row_id", "messages")
    dpo = _table(spark, sf_dir, "dpo_train").select("row_id", "prompt", "chosen", "rejected")
    return pairs.found(sft, dpo, pairs.fit(sft, dpo))


def _splits(spark: SparkSession, sf_dir: str) -> dict:
    return {
        (stage, split): (_table(spark, sf_dir, f"{stage}_{split}"), column)
        for stage, column in (("sft", "messages"), ("dpo", "prompt"))
        for split in ("val", "train")
    }


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import overlap

    _batches(spark)
    return overlap.found(spark, _splits(spark, sf_dir))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import overlap

    _batches(spark)
    return overlap.report(spark, _splits(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import scans

    _batches(spark, 500)
    return scans.Scans(spark, _table(spark, sf_dir, "textbook_pages")).lines()


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import scans

    _batches(spark, 500)
    return scans.Scans(spark, _table(spark, sf_dir, "textbook_pages")).paragraphs()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import language, quality

    _batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    with ThreadPoolExecutor(1) as other:  # the profiles' job runs while the network is trained on the driver
        profiles = other.submit(quality.fit, docs)
        return language.found(docs, language.fit(docs), profiles.result())


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import language

    _batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.documents(docs, language.fit(docs))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import language

    _batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.segments(docs, language.fit(docs))


def p5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import mixture

    goals = _table(spark, sf_dir, "mix_targets")
    sft = mixture.stored(mixture.sized(_table(spark, sf_dir, "sft_train"), "messages"))
    dpo = mixture.stored(mixture.sized(_table(spark, sf_dir, "dpo_train"), "prompt", ("chosen", "rejected")))
    return mixture.mixture(sft, goals, "sft").unionByName(mixture.mixture(dpo, goals, "dpo"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import mixture

    return mixture.shares(p5_mixture(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import packing

    return packing.packed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pack_specs"))


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import packing

    return packing.summary(p6_packed(spark, sf_dir), _table(spark, sf_dir, "pack_specs"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import bpe

    _batches(spark)
    return bpe.encode_table(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids are not their text; none, but for unpaired surrogates."""
    from skein.llm import bpe

    _batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode_table(bpe.encode_table(docs)).withColumnRenamed("text", "decoded")
    both = docs.join(back, "doc_id").select((F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))
    return both.groupBy("same").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import leakage

    _batches(spark)
    return leakage.found(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked documents of each item, by the item's task and the document's source."""
    from skein.llm import leakage

    _batches(spark)
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")
    hits = leakage.found(docs.select("doc_id", "text"), items)
    of = hits.join(docs.select("doc_id", "source"), "doc_id").join(items.select("item_id", "task"), "item_id")
    return of.groupBy("task", "source").agg(F.count("*").alias("n_leaks"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import quality

    _batches(spark)
    texts = quality.stored(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return quality.found(texts, quality.learn(texts))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import quality

    _batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.statistics(docs, quality.fit(docs))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_report, p3_found, p3_paragraphs, p4_found, p4_documents, p4_segments, p5_mixture, p5_shares, p6_packed, p6_summary, p7_ids, p7_round_trip, p8_found, p8_report, p9_found, p9_statistics)
}


def oracle_sql() -> dict[str, str]:
    """No query here is expressible in plain SQL; they are tested against brute force, round trips and held-out rows."""
    return {}
