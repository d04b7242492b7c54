"""Column functions made of the kernels, a batch at a time over Arrow; also registered by name for SQL.

``errors="null"`` turns what a kernel refuses into null; the default is to fail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import Options
from . import batches, codec, codes, compare, sketches, text

META = "code string, metahash string, name string, description string, meta string, version int"
TEXT = "code string, characters int"
CODE = "code string"
MIXED = "code string, parts array<string>"
INSTANCE = "code string, datahash string, filesize long"
DECODED = "main int, sub int, version int, length int, body binary"
COMPARED = "meta_dist int, semantic_dist int, content_dist int, data_dist int, id_dist int, flake_dist int, instance_match boolean, id_match boolean"
INSPECTED = (
    "code string, uri string, bytes binary, hex string, base32hex string, header_bytes binary, uint string, type_id string, explain string, maintype string, subtype string, version int, length int, "
    "hash_bytes binary, hash_hex string, hash_base32 string, hash_base32hex string, hash_bits string, hash_ints array<int>, hash_uint string, mc_bytes binary, mf_base16 string, mf_base32 string, mf_base32hex string, mf_base58btc string, mf_base64url string, known_length boolean"
)


def _value(x):
    if isinstance(x, bytearray | memoryview):
        return bytes(x)
    if hasattr(x, "tolist"):  # arrays, also of arrays
        return [_value(v) for v in x.tolist()] if getattr(x, "ndim", 0) else x.item()
    return x


def _missing(x) -> bool:
    return x is None or (isinstance(x, float) and x != x) or x is pd.NA


_REFUSED = (ValueError, IndexError, KeyError, UnicodeError, OverflowError)


def _rows(part) -> Iterator[tuple]:
    return zip(*(part if isinstance(part, tuple) else (part,)), strict=True)


def vectorised_udf(fn: Callable, returns: str, *, needed: int = 1, errors: str = "raise"):
    """A function for Spark of fn, which gets plain values.  A null among the first ``needed`` arguments gives null."""
    kind = T._parse_datatype_string(returns)
    names = kind.names if isinstance(kind, T.StructType) else None

    def one(*args):
        args = [None if _missing(a) else _value(a) for a in args]
        if any(a is None for a in args[:needed]):
            return None
        try:
            return fn(*args)
        except _REFUSED:
            if errors == "null":
                return None
            raise

    if names:

        def batch(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = [one(*row) or {} for row in _rows(part)]
                yield pd.DataFrame({n: pd.Series([f.get(n) for f in found], dtype=object) for n in names})

    else:

        def batch(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([one(*row) for row in _rows(part)], dtype=object)

    return F.pandas_udf(batch, kind)


def vectorised(fn: Callable, returns: str, **options) -> Callable[..., Column]:
    """A column function of fn; see vectorised_udf."""
    many = vectorised_udf(fn, returns, **options)
    return lambda *cols: many(*(F.col(c) if isinstance(c, str) else c for c in cols))


def batched_udf(fn: Callable, returns: str, *, needed: int = 1, errors: str = "raise"):
    """A function for Spark of fn, which gets the rows of a batch (tuples of plain values) and returns one result for each.

    A null among the first ``needed`` arguments gives null, and fn doesn't see the row.  With
    errors="null", a batch that fn refuses goes to it again, each row alone.
    """
    kind = T._parse_datatype_string(returns)
    names = kind.names if isinstance(kind, T.StructType) else None

    def alone(row: tuple):
        try:
            return fn([row])[0]
        except _REFUSED:
            return None

    def results(part) -> list:
        rows = [tuple(None if _missing(a) else _value(a) for a in row) for row in _rows(part)]
        at = [i for i, row in enumerate(rows) if all(a is not None for a in row[:needed])]
        found: list = [None] * len(rows)
        if at:
            try:
                done = fn([rows[i] for i in at])
            except _REFUSED:
                if errors != "null":
                    raise
                done = [alone(rows[i]) for i in at]
            for i, x in zip(at, done, strict=True):
                found[i] = x
        return found

    if names:

        def batch(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = [x or {} for x in results(part)]
                yield pd.DataFrame({n: pd.Series([f.get(n) for f in found], dtype=object) for n in names})

    else:

        def batch(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(results(part), dtype=object)

    return F.pandas_udf(batch, kind)


def _flakes(options: Options) -> Callable[..., Column]:
    """Flake codes that no two tasks of a job share: the number of the partition is in the counter's highest bits."""
    makers: dict = {}

    def batch(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        context = TaskContext.get()
        key = (context.stageId(), context.partitionId(), context.attemptNumber()) if context else None
        for bits, n in parts:
            if key not in makers:
                makers.clear()
                makers[key] = codes.Flake(part=key[1] if key else 0, parts=max(int(n.iloc[0]), (key[1] if key else 0) + 1) if len(n) else 1)
            yield pd.Series([codes.flake_code(None if _missing(b) else int(b), options=options, maker=makers[key])["code"] for b in bits], dtype=object)

    many = F.pandas_udf(batch, "string").asNondeterministic()
    return lambda bits, partitions=1 << 12: many(F.col(bits) if isinstance(bits, str) else bits, F.lit(partitions))


class Functions:
    """Column functions under one set of options (of the session, say)."""

    def __init__(self, options: Options | None = None, errors: str = "raise"):
        o = self.options = options or Options()

        def make(fn, returns, needed=1):
            return vectorised(fn, returns, needed=needed, errors=errors)

        def many(fn, returns, needed=1):
            udf = batched_udf(fn, returns, needed=needed, errors=errors)
            return lambda *cols: udf(*(F.col(c) if isinstance(c, str) else c for c in cols))

        # normalisation and JSON
        self.text_clean = make(text.clean, "string")
        self.text_collapse = make(text.collapse, "string")
        self.text_trim = make(text.trim, "string")
        self.is_json = make(text.is_json, "boolean")
        self.json_minify = make(text.minify, "string")
        self.json_canonical = make(lambda s: text.canonical_json(text._parse(s)), "binary")
        # codes
        self.meta_code = many(lambda rows: batches.meta_codes(rows, o), META)
        self.text_code = many(lambda rows: batches.text_codes(rows, o), TEXT)
        self.image_code = many(lambda rows: batches.image_codes(rows, o), CODE)
        self.audio_code = make(lambda v, bits=None: codes.audio_code(v, bits, options=o), CODE)
        self.video_code = make(lambda f, bits=None: codes.video_code(f, bits, options=o), CODE)
        self.mixed_code = make(lambda c, bits=None: codes.mixed_code(c, bits, options=o), MIXED)
        self.data_code = many(lambda rows: batches.data_codes(rows, o), CODE)
        self.instance_code = many(lambda rows: batches.instance_codes(rows, o), INSTANCE)
        self.text_asset_code = many(lambda rows: batches.text_asset_codes(rows, o), "string", 2)
        self.compose = make(lambda c, wide=False: codec.compose(c, bool(wide)), "string")
        self.flake_code = _flakes(o)
        self.time_id = make(lambda t, hub=0, realm=0: codes.time_id(t, hub, realm)["code"], "string")
        self.wallet_id = make(lambda c, chain, wallet, counter=0: codes.wallet_id(c, chain, wallet, counter or 0)["code"], "string", 3)
        self.next_wallet_id = make(codes.next_wallet_id, "string")
        self.wallet_id_simhash = make(codes.wallet_id_simhash, "string", 2)
        # soft hashes and sketches
        self.soft_hash_text = many(lambda rows: batches.text_hashes([r[0] for r in rows], o), "binary")
        self.soft_hash_meta = make(lambda n, extra=None: codes.soft_hash_meta(n, extra, options=o), "binary")
        self.soft_hash_image = make(lambda p, bits=64: codes.soft_hash_image(p, bits), "binary")
        self.soft_hash_audio = make(lambda v, bits=64: codes.soft_hash_audio(v, bits), "binary")
        self.soft_hash_video = make(lambda f, bits=64: codes.soft_hash_video(f, bits), "binary")
        self.soft_hash_data = many(lambda rows: batches.data_hashes([r[0] for r in rows], o), "binary")
        self.simhash = make(sketches.simhash, "binary")
        self.minhash = make(lambda f: sketches.minhash(f).tolist(), "array<long>")
        self.minhash_64 = make(sketches.minhash_64, "binary")
        self.minhash_256 = make(sketches.minhash_256, "binary")
        self.chunk_ends = make(lambda d: sketches.chunk_ends(d, o.data_avg_chunk_size), "array<int>")
        self.blake3 = many(lambda rows: batches.hashed([r[0] for r in rows]), "binary")
        self.xxh32 = many(lambda rows: codes.xxh32([r[0] for r in rows]).tolist(), "long")
        # codec
        self.code_normalize = make(codec.normalize, "string")
        self.code_validate = make(lambda c: codec.validate(c, False), "boolean")
        self.code_validate_mf = make(lambda c: codec.validate_multiformat(c, False), "boolean")
        self.code_decompose = make(codec.decompose, "array<string>")
        self.code_decode = make(lambda c: codec.decode(c)._asdict(), DECODED)
        self.code_type_id = make(codec.type_id, "string")
        self.code_explain = make(codec.explain, "string")
        self.code_inspect = make(codec.inspect, INSPECTED)
        self.code_multiformat = make(codec.multiformat, "string", 2)
        self.base58 = make(codec.base58, "string")
        self.from_base58 = make(codec.from_base58, "binary")
        self.from_base32 = make(codec.from_base32, "binary")
        # comparison
        self.code_distance = make(compare.distance, "int", 2)
        self.code_similarity = make(compare.similarity, "int", 2)
        self.code_compare = make(compare.compare, COMPARED, 2)
        self.prefix_similarity = make(lambda a, b: dict(zip(("similarity", "common_prefix_bits"), compare.prefix_similarity(a, b), strict=True)), "similarity double, common_prefix_bits int", 2)
        self.prefix_distance = make(lambda a, b: dict(zip(("distance", "common_prefix_bits"), compare.prefix_distance(a, b), strict=True)), "distance double, common_prefix_bits int", 2)
        self.cid_to_token = make(lambda t: str(compare.cid_to_token(t)), "string")
        self.cid_from_token = make(lambda t: compare.cid_from_token(int(t)), "string")


def register(spark: SparkSession, prefix: str = "loom_", options: Options | None = None) -> list[str]:
    """Registers functions for SQL, under prefix + name.  Returns the names."""
    o = options or Options()
    own = lambda field, fn: lambda rows: [r[field] for r in fn(rows, o)]
    of = lambda fn, field="code": lambda *a: fn(*a, options=o)[field]
    #: a batch at a time: function of rows, result, arguments that mustn't be null
    together = {
        "text_code": (own("code", batches.text_codes), "string", 1),
        "data_code": (own("code", batches.data_codes), "string", 1),
        "instance_code": (own("code", batches.instance_codes), "string", 1),
        "datahash": (own("datahash", batches.instance_codes), "string", 1),
        "meta_code": (own("code", batches.meta_codes), "string", 1),
        "metahash": (own("metahash", batches.meta_codes), "string", 1),
        "image_code": (own("code", batches.image_codes), "string", 1),
        "text_asset_code": (lambda rows: batches.text_asset_codes(rows, o), "string", 2),
        "soft_hash_text": (lambda rows: batches.text_hashes([r[0] for r in rows], o), "binary", 1),
        "soft_hash_data": (lambda rows: batches.data_hashes([r[0] for r in rows], o), "binary", 1),
        "blake3": (lambda rows: batches.hashed([r[0] for r in rows]), "binary", 1),
        "xxh32": (lambda rows: codes.xxh32([r[0] for r in rows]).tolist(), "long", 1),
    }
    table = {
        "text_clean": (text.clean, "string", 1),
        "text_collapse": (text.collapse, "string", 1),
        "text_trim": (text.trim, "string", 1),
        "is_json": (text.is_json, "boolean", 1),
        "json_minify": (text.minify, "string", 1),
        "json_canonical": (lambda s: text.canonical_json(text._parse(s)), "binary", 1),
        "audio_code": (of(codes.audio_code), "string", 1),
        "video_code": (of(codes.video_code), "string", 1),
        "mixed_code": (of(codes.mixed_code), "string", 1),
        "soft_hash_meta": (lambda n, extra=None: codes.soft_hash_meta(n, extra, options=o), "binary", 1),
        "soft_hash_image": (lambda p, bits=64: codes.soft_hash_image(p, bits), "binary", 1),
        "soft_hash_audio": (lambda v, bits=64: codes.soft_hash_audio(v, bits), "binary", 1),
        "soft_hash_video": (lambda f, bits=64: codes.soft_hash_video(f, bits), "binary", 1),
        "simhash": (sketches.simhash, "binary", 1),
        "minhash": (lambda f: sketches.minhash(f).tolist(), "array<long>", 1),
        "compose": (codec.compose, "string", 1),
        "time_id": (lambda t, hub=0, realm=0: codes.time_id(t, hub, realm)["code"], "string", 1),
        "wallet_id": (lambda c, chain, wallet, counter=0: codes.wallet_id(c, chain, wallet, counter or 0)["code"], "string", 3),
        "next_wallet_id": (codes.next_wallet_id, "string", 1),
        "wallet_id_simhash": (codes.wallet_id_simhash, "string", 2),
        "code_normalize": (codec.normalize, "string", 1),
        "code_validate": (lambda c: codec.validate(c, False), "boolean", 1),
        "code_validate_mf": (lambda c: codec.validate_multiformat(c, False), "boolean", 1),
        "code_multiformat": (codec.multiformat, "string", 2),
        "code_decompose": (codec.decompose, "array<string>", 1),
        "code_decode": (lambda c: codec.decode(c)._asdict(), DECODED, 1),
        "code_explain": (codec.explain, "string", 1),
        "code_type_id": (codec.type_id, "string", 1),
        "code_inspect": (codec.inspect, INSPECTED, 1),
        "code_distance": (compare.distance, "int", 2),
        "code_similarity": (compare.similarity, "int", 2),
        "code_compare": (compare.compare, COMPARED, 2),
        "prefix_similarity": (lambda a, b: compare.prefix_similarity(a, b)[0], "double", 2),
        "prefix_distance": (lambda a, b: compare.prefix_distance(a, b)[0], "double", 2),
        "cid_to_token": (lambda t: str(compare.cid_to_token(t)), "string", 1),
        "cid_from_token": (lambda t: compare.cid_from_token(int(t)), "string", 1),
    }
    for name, (fn, returns, needed) in together.items():
        spark.udf.register(prefix + name, batched_udf(fn, returns, needed=needed))
    for name, (fn, returns, needed) in table.items():
        spark.udf.register(prefix + name, vectorised_udf(fn, returns, needed=needed))
    return [prefix + n for n in (*together, *table)]
