"""Query op6: all documents mixed to weights 5, 2, 1 over their sources."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix_sources

NAME = "op6_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
