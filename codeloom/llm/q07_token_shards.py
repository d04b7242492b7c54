"""Query op7: token ids of all documents, written as sorted string tables and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_shards import read_token_shards, write_token_shards

NAME = "op7_token_shards"


def written_and_read(docs: DataFrame) -> DataFrame:
    entries = read_token_shards(write_token_shards(docs.select("doc_id", "text")))
    return entries.select(F.col("id").alias("doc_id"), F.col("first").alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"))
