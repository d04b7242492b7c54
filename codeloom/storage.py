"""Shared scratch storage.

Everything a job leaves between stages goes below one folder that the driver and all executors
share: ``spark.checkpoint.dir`` of the session, or else the checkpoint folder set on its context.
Only on a local master without either (unit tests, a laptop) a temporary folder of this machine is
made; on a cluster that is an error.  ``clean`` deletes what this process has left there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN[app] = tempfile.mkdtemp(prefix="codeloom-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        root = _OWN[app]
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared root."""
    path = f"{shared_root(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def clean() -> int:
    """Deletes all scratch folders of this process; to be called once results have been written.  Returns how many there were."""
    n = 0
    while _MADE:
        fs, path = _open(_MADE.pop())
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)
            n += 1
    return n


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared root and reads it again: later stages start from the files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, write) -> None:
    """write(stream) fills a temporary name that then takes its place at once: readers never see half a file."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def open_input(uri: str):
    """A seekable stream of a file below the shared root."""
    fs, path = _open(uri)
    return fs.open_input_file(path)
