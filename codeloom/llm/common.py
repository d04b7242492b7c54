"""Small helpers that several operators use."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..naming import fresh

__all__ = ["fresh", "held", "release", "table", "tokenizer_file", "with_arrow"]


def with_arrow(docs: DataFrame, text_col: str, fn: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], added: list[T.StructField]) -> DataFrame:
    """docs with more columns, made by mapInArrow; fn gets batches and the place of the text column.  Names of docs may have dots."""
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added))])
    return plain.mapInArrow(lambda batches: fn(batches, at), schema).toDF(*names, *(f.name for f in added))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies: $TOKENIZER_DIR if set, else the installed package's folder."""
    if os.environ.get("TOKENIZER_DIR"):
        return os.path.join(os.environ["TOKENIZER_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """make(), kept for the next call with this key.  A Python worker serves tasks of many stages; it keeps one large thing at a time."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Gives back what another stage's tasks have left in this worker."""
    _HELD.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: memory goes back in its own time
