"""Files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, content of each file below path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content")


def blocks(assets: DataFrame, ident: str, data: str, size: int) -> DataFrame:
    """Blocks of size bytes of each asset: ident, seq, block, last.  An empty asset has one empty block; null has none."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size).cast("int"))
    rows = assets.filter(F.col(data).isNotNull()).select(ident, data, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select(ident, "seq", F.substring(F.col(data), F.col("seq") * size + 1, F.lit(size)).alias("block"), (F.col("seq") == F.col("n") - 1).alias("last"))


def grey_pixels(rgb: str, width: str, height: str):
    """1024 grey values of packed RGB bytes: luma of the nearest pixel of a 32 x 32 grid."""
    import numpy as np

    from ..functions.columns import vectorised

    def shrink(data: bytes, w: int, h: int) -> list[float]:
        pixels = np.frombuffer(data, dtype=np.uint8)[: 3 * w * h].reshape(h, w, 3).astype(np.float64)
        grid = pixels[np.arange(32) * h // 32][:, np.arange(32) * w // 32]
        return np.floor(grid @ np.array([0.299, 0.587, 0.114]) + 0.5).ravel().tolist()

    return vectorised(shrink, "array<double>", needed=3)(rgb, width, height)


def golden_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file {function: {test: {inputs, outputs}}}: func_name, test_name, inputs, outputs (both JSON text)."""
    kind = "map<string, map<string, struct<inputs: string, outputs: string>>>"
    text = spark.read.text(path, wholetext=True)
    by_func = text.select(F.explode(F.from_json("value", kind)).alias("func_name", "tests"))
    rows = by_func.select("func_name", F.explode("tests").alias("test_name", "t"))
    return rows.select("func_name", "test_name", "t.inputs", "t.outputs")


def golden_value(value):
    """A golden record's argument: "stream:" and "bytes:" stand before bytes in hex."""
    if isinstance(value, str) and value.startswith(("stream:", "bytes:")):
        return bytes.fromhex(value.partition(":")[2])
    return value
