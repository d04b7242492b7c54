"""Token ids of documents in sorted-string-table shards, in order of the document id.

Documents are range-partitioned by id (Spark samples the bounds, repeated ids are told apart by
their text), and sorted inside each partition; a task encodes its texts as they come and streams the ids into one file
below the shared folder, under a name of its own that takes its place only when complete, and
reports it in a manifest that is written before anything reads it: a task that runs again
leaves at most an unused file.  Readers take the manifest's files one by one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, tokenizer_file
from .sstable import Reader, Writer
from .storage import open_input, persisted, scratch, write_file
from .wordscan import slices

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Texts of these characters alone, with no two of the marks side by side, are cut by plain splitting.
_PLAIN = re.compile(f"[{_LETTERS}0-9][{_LETTERS}0-9 \\n.,]*")
_MARKS_MEET = [a + b for a in " \n.," for b in " \n.," if a + b not in (". ", ", ", ".\n", ",\n")]
_AS_IS = "\x01"
_ENDS, _BLANKS = frozenset(("", _AS_IS, ".", ",", "\n")), ("", " ", "\n")
_MOST_KEPT = 700_000


class Encoder:
    """A byte-level BPE of the tokenizers library, with the ids of recurring units kept.

    The byte-level pre-tokenizer always begins a new token where white space follows another
    character and where a full stop or comma follows a letter or digit, and looks at nothing before
    it; so the ids of a text are those of its units, each encoded by the library.  A unit is a run
    of blanks and line ends with the other characters up to the next one; in texts of letters,
    digits, single blanks, line ends, full stops and commas it also ends before the latter two.
    Texts with other white space or with an added token's string are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = _Kept()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():  # in a byte-level vocabulary each character stands for a byte
            self.lengths[k] = len(token)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.units_stand_alone = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keys(self, text: str) -> list[str] | None:
        """The text's units as keys of what is kept; a key without a mark in front stands for a blank and itself."""
        if not self.units_stand_alone:
            return None
        if _PLAIN.fullmatch(text) and not any(map(text.__contains__, _MARKS_MEET)):
            keys = text.replace(".", " .").replace(",", " ,").replace("\n", " \n").split(" ")
            keys[0] = _AS_IS + keys[0]
            return keys
        if _OTHER_SPACE.search(text) or (self.added and self.added.search(text)):
            return None
        return [u[1:] if u[0] == " " and u[1:2] > "." else _AS_IS + u for u in _UNIT.findall(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit integers."""
        keys = [self._keys(t) for t in texts]
        whole = iter(self._encode([t for t, k in zip(texts, keys, strict=True) if k is None]))
        if len(self.kept) > _MOST_KEPT:
            self.kept.clear()
        of = self.kept.__getitem__
        found = [[next(whole)] if k is None else list(map(of, k)) for k in keys]
        self.kept.fill(self)
        return [b"".join(f) for f in found]

    def encode_units(self, keys: list[str]) -> Iterator[tuple[str, bytes]]:
        """Keys with the ids of their units.  Units of one blank or line end and other characters make one text, cut again by the lengths of its tokens."""
        plain = [k for k in keys if k[:1] not in _ENDS]
        lines = [k for k in keys if k[:1] == "\n" and k[1:2] not in _BLANKS]
        for some, text in ((plain, " " + " ".join(plain)), (lines, "".join(lines))):
            if some:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                ends = np.append(np.flatnonzero((data == 0x20) | (data == 0x0A))[1:], len(data))
                bounds = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 4).tolist()
                all_ids = ids.tobytes()
                yield from zip(some, [all_ids[a:b] for a, b in zip([0, *bounds], bounds, strict=False)], strict=True)
        other = [k for k in keys if k[:1] in _ENDS and not (k[:1] == "\n" and k[1:2] not in _BLANKS)]
        yield from zip(other, self._encode([k[1:] if k[:1] == _AS_IS else k or " " for k in other]), strict=True)


class _Kept(dict):
    """Ids by unit.  A missing unit gets a buffer, which fill() fills; users of the buffer see it filled."""

    def __init__(self):
        self.missed: dict[str, bytearray] = {}

    def __missing__(self, key: str) -> bytearray:
        out = self[key] = self.missed[key] = bytearray()
        return out

    def fill(self, encoder: Encoder) -> None:
        if self.missed:
            for unit, ids in encoder.encode_units(list(self.missed)):
                self.missed[unit] += ids
                self[unit] = ids
            self.missed = {}


def encoder(name: str) -> Encoder:
    return held(("encoder", name), lambda: Encoder(tokenizer_file(name)))


def write_token_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the shards; returns the manifest: part, path, entries, ids (n_ids), in id order by part.

    Null and empty texts have the end id alone.  Rows without an id come first, under the empty
    key; rows with the same id are kept as separate entries, ordered by text.  No rows: no
    entries.  Other columns are not read.
    """
    spark = docs.sparkSession
    root = scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a short hash tells equal ids apart when ranges are chosen; the text settles the rest
    rows = rows.withColumn("h", F.crc32(F.col("t").cast("binary"))).repartitionByRange(shards, F.asc_nulls_first("k"), "h").sortWithinPartitions(F.asc_nulls_first("k"), "h", "t").withColumn("p", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end, done = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), {}
        path, part = f"{root}/{uuid.uuid4().hex}.sst", None
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def fill(out) -> None:
            nonlocal part
            w = Writer(out)

            def every():
                yield first
                yield from batches

            for batch in every():
                part = batch.column(3)[0].as_py() if batch.num_rows and part is None else part
                for piece in slices(batch, "t", 2 << 20):
                    for k, ids in zip(piece.column(0).to_pylist(), e.encode(piece.column(1).to_pylist()), strict=True):
                        w.add(k, ids + end)
            w.close()
            done.update(entries=w.entries, ids=w.ids)

        write_file(path, fill)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [path], "entries": pa.array([done["entries"]], pa.int64()), "n_ids": pa.array([done["ids"]], pa.int64())})

    return persisted(rows.select("k", "t", "h", "p").mapInArrow(write, "part long, path string, entries long, n_ids long"), "token-manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Every entry of the shards: id, first (ids in all entries before it), n_tokens, crc32 of its ids; part and slot give the order."""
    # one row for each file: few next to the documents, and summed before any file is read
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as f:
                    at, slot, out = row["base"], 0, []
                    for k, ids in Reader(f):
                        out.append((k, at, len(ids) // 4, zlib.crc32(ids), row["part"], slot))
                        at, slot = at + len(ids) // 4, slot + 1
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    return files.mapInArrow(read, "id long, first long, n_tokens long, ids_crc32 long, part long, slot long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "first", "n_tokens", "ids_crc32", "part", "slot"])
