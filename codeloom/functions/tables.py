"""Table functions for SQL: one value in, rows out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import codec, sketches, text


@udtf(returnType="no int, offset int, size int")
class Chunks:
    """Content-defined chunks of bytes."""

    def eval(self, data: bytes, average: int = 1024):
        if data is not None:
            start = 0
            for no, end in enumerate(sketches.chunk_ends(bytes(data), average)):
                yield no, start, end - start
                start = end


@udtf(returnType="no int, unit string, main int, sub int, version int, body binary")
class Units:
    """Units of a code."""

    def eval(self, code: str):
        if code is not None:
            for no, unit in enumerate(codec.decompose(code)):
                c = codec.parse(codec.from_base32(unit))
                yield no, unit, c.main, c.sub, c.version, c.body


@udtf(returnType="no int, gram string")
class Windows:
    """All runs of so many characters."""

    def eval(self, value: str, width: int):
        if value is not None:
            yield from enumerate(text.sliding_window(value, width))


@udtf(returnType="bucket int, no int, value bigint")
class Buckets:
    """An array's values in n slices of ceil(size / n)."""

    def eval(self, values: list[int], n: int):
        for bucket, part in enumerate(sketches.divide(n, list(values or []))):
            for no, value in enumerate(part):
                yield bucket, no, value


TABLES = {"chunks": Chunks, "units": Units, "windows": Windows, "buckets": Buckets}


def register_tables(spark: SparkSession, prefix: str = "loom_") -> list[str]:
    """Registers the table functions under prefix + name."""
    for name, table in TABLES.items():
        spark.udtf.register(prefix + name, table)
    return [prefix + n for n in TABLES]
