import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("found", "shard", "quality", "n_tokens", "_id", "_key", "deduped", "key", "block")]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with null columns whose names clash with those that operators use inside; rows are (doc_id, text) or (doc_id, text, source)."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, *[None] * 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make
