"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents. ``run`` writes each stage's result as Parquet in
the shared folder and rereads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grafspan.llm import common, decontaminate, language, near_dedup, piece_sampling, quality

#: Documents below this calibrated score go: those that the classifier rejects.
LEAST_QUALITY = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.remove_low_quality(docs, model, least=LEAST_QUALITY)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.remove_unidentified(docs, language.fit(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.remove_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_pieces(docs, piece_sampling.default_vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("language identification", keep_identified),
    ("near-duplicate removal", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("piece encoding", encode),
]

#: Not expressible in SQL (trained models, sampling); tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.store(docs, f"pipeline-{k}")
    return docs
