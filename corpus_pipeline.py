"""The corpus pipeline: from raw documents to token shards, in five stages.

Each stage works on all that its predecessor kept; its result is written as Parquet in the shared
folder and read again as the next stage's documents.  The stages:

1. quality rules: documents that the base rule or the rules learned from ``labels`` reject go;
2. n-gram Jaccard join: of each group of documents linked by similar sets of five-word shingles
   (0.8 and more) the one of the least id stays;
3. benchmark decontamination: documents that hold ten words in a row of a benchmark item (or a
   whole shorter item) go;
4. mixing: sources are brought to their target weights; a document may come twice;
5. token shards: the texts' token ids are written as sorted string tables, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import table
from codeloom.llm.decontamination import find_contamination
from codeloom.llm.jaccard import drop_similar
from codeloom.llm.mixing import mixed_documents
from codeloom.llm.q07_token_shards import written_and_read
from codeloom.llm.quality_rules import judge, learn_from
from codeloom.llm.storage import persisted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = judge(docs, learn_from(docs, table(spark, sf_dir, "labels")))
    return judged.filter(judged[judged.columns[-1]]["kept"]).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(found[found.columns[-1]]["n_hit"] == 0).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written_and_read(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]

#: Learned rules and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
