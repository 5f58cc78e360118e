"""The corpus pipeline: language, near duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes what a stage returns as
Parquet in the shared folder and hands the next stage the table read back. All but the last return
the columns of documents. No stage can be stated as SQL, so ORACLE_SQL is None and the tests compare
run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, language, mixing, near, store, tokenfiles


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language stays unclear."""
    return language.identified(docs)


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8 or more."""
    return near.unique(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def order_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and orders documents by the curriculum."""
    return mixing.training_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids in the order of docs, a table read back, and returns what the files hold."""
    import public_tokenizers

    folder = store.new_path(spark, "pipeline-ids")
    name = F.col("_metadata.file_name")
    order = [*(F.regexp_extract(name, part, 1).try_cast("long") for part in (r"^part-(\d+)", r"-c(\d+)")), F.col("_metadata.row_index")]
    index = tokenfiles.write_ids(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), order=order)
    return tokenfiles.read_ids(spark, folder, index)


STAGES = [
    ("language ID", keep_identified),
    ("MinHash near-dedup", keep_unique),
    ("benchmark decontamination", drop_leaks),
    ("mixing", order_mix),
    ("token ids", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if old:
            store.drop_path(spark, old)
        old = path
    return docs
