"""Options of the engine: defaults, the environment's overrides, and a check of what must not differ."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    meta_bits: int = 64
    text_bits: int = 64
    image_bits: int = 64
    audio_bits: int = 64
    video_bits: int = 64
    mixed_bits: int = 64
    data_bits: int = 64
    instance_bits: int = 64
    flake_bits: int = 64
    meta_trim_name: int = 128
    meta_trim_description: int = 4096
    max_meta_bytes: int = 10_000_000
    meta_ngram_size_text: int = 3
    meta_ngram_size_bytes: int = 4
    text_ngram_size: int = 13
    data_avg_chunk_size: int = 1024
    io_read_size: int = 2_097_152


#: What codes depend on beyond their length: other values make codes that others can't compare.
MUST_AGREE = ("meta_trim_name", "meta_trim_description", "meta_ngram_size_text", "meta_ngram_size_bytes", "text_ngram_size", "data_avg_chunk_size")


def load_options(source: dict[str, str] | None = None, prefix: str = "CODELOOM_") -> Options:
    """Defaults, with values of the environment (or another mapping) under prefix + NAME (pass the prefix that an environment has).  What doesn't begin with an integer is ignored."""
    source = dict(os.environ) if source is None else source
    found = {}
    for f in fields(Options):
        m = re.match(r"\s*([+-]?\d+)", source.get(prefix + f.name.upper(), ""))
        if m:
            found[f.name] = int(m[1])
    return replace(Options(), **found)


def session_options(spark: SparkSession) -> Options:
    """Options of a session: the environment's, with spark.codeloom.<name> above them.  Read once, when a plan is made."""
    own = {f.name: spark.conf.get(f"spark.codeloom.{f.name}", None) for f in fields(Options)}
    return replace(load_options(), **{k: int(v) for k, v in own.items() if v is not None})


def conformant(options: Options) -> bool:
    """Whether codes can be compared with others' codes; logs each difference."""
    bad = [n for n in MUST_AGREE if getattr(options, n) != getattr(Options(), n)]
    for n in bad:
        _LOG.warning("option %s is %s instead of %s: codes will not be comparable", n, getattr(options, n), getattr(Options(), n))
    return not bad
