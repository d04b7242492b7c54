"""Tables with codes: one more column, or one more row for each unit or chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Functions
from ..naming import exactly


def with_text_code(df: DataFrame, text: str, into: str = "text_code", f: Functions | None = None) -> DataFrame:
    """df with a struct: code, characters."""
    return df.withColumn(into, (f or Functions()).text_code(text))


def with_asset_code(df: DataFrame, name: str, text: str, into: str = "asset_code", f: Functions | None = None) -> DataFrame:
    """df with the composite of a text asset: of its name, its text, and the UTF-8 bytes of the text; null where either is null.  One pass over each Arrow batch."""
    f = f or Functions()
    return df.withColumn(into, f.text_asset_code(exactly(name), exactly(text)))


def units(df: DataFrame, ident: str, code: str, f: Functions | None = None) -> DataFrame:
    """A row for each unit of each code: ident, unit, main, sub, version, body."""
    f = f or Functions()
    rows = df.select(ident, F.explode(f.code_decompose(code)).alias("unit"))
    return rows.select(ident, "unit", f.code_decode("unit").alias("c")).select(ident, "unit", "c.main", "c.sub", "c.version", "c.body")


def chunks(df: DataFrame, ident: str, data: str, f: Functions | None = None) -> DataFrame:
    """A row for each content-defined chunk: ident, no, offset, size."""
    f = f or Functions()
    rows = df.select(ident, F.posexplode(f.chunk_ends(data)).alias("no", "stop"), f.chunk_ends(data).alias("ends"))
    start = F.when(F.col("no") == 0, 0).otherwise(F.get("ends", F.col("no") - 1))
    return rows.select(ident, "no", start.alias("offset"), (F.col("stop") - start).alias("size"))
