"""The corpus pipeline: identify, deduplicate, decontaminate and encode all documents.

Every stage takes the documents that the stage before kept, as stored, and all but the last
return documents with their columns. Rejected by language ID are documents whose language stays
undetermined; of each group of near duplicates the one with the smallest id stays; repeated
passages of 100 bytes and more stay where they come first; documents with a benchmark passage go.
"""

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcequarry.llm import bpe, decontaminate, language_id, simhash, suffix_dedup
from sourcequarry.llm.common import ship_package
from sourcequarry.llm.queries import vocabulary
from sourcequarry.runtime import materialize

#: Documents that are handed to Python at once: what is held beside them, by the executor and its workers,
#: then stays small even where the stage before has left them large.
ROWS_AT_A_TIME = 1_000


def stage(function):
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_A_TIME)
        return function(spark, docs, sf_dir)

    return run


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, "lang")
    return language_id.identify(docs, model, declared=F.col("lang"), host=F.col("source")).where("not rejected").select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    return encoded.select("doc_id", "lang", "source", "text", bpe.token_count("ids").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate_documents),
    ("bpe_encoding", encode),
]

#: SQL cannot express SimHash or BPE; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
