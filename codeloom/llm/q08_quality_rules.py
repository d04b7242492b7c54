"""Query op8: which documents the base rule and the learned rules keep."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality_rules import judge, learn_from

NAME = "op8_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    q = "quality.stats"
    return judge(docs, rules).select("doc_id", f"{q}.n_words", f"{q}.word_chars", f"{q}.n_symbols", f"{q}.n_dup_lines", f"{q}.n_repeat_words", "quality.base_failed", "quality.kept")
