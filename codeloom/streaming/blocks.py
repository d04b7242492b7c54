"""Data and instance codes of assets whose blocks come as a stream, in any order within and across batches.

State for each open asset: the two hashers (64 least values and at most one chunk; a chaining value
for each level and at most 1 KiB), the next block's number, and the blocks that came too early, all
of them: a source that sends blocks far out of order needs state for what waits.  An asset that
misses a block stays open, on a stream until its timeout; then its row has null codes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.codes import DataHasher, InstanceHasher
from ..functions.constants import SCHEME
from ..functions.hashing import Blake3

_STATE = "data binary, instance binary, next int, end int, early map<int, binary>"
_OUT = "code_data string, code_instance string, datahash string, filesize long"


class _Asset:
    def __init__(self, state: tuple | None = None):
        self.data, self.instance, self.next, self.end, self.early = DataHasher(), InstanceHasher(), 0, -1, {}
        if state is not None:
            self.data = DataHasher.from_state(bytes(state[0]))
            self.instance.blake3 = Blake3.from_state(bytes(state[1]))
            self.next, self.end, self.early = state[2], state[3], {int(k): bytes(v) for k, v in dict(state[4] or {}).items()}

    def add(self, seq: int, block: bytes, last: bool) -> None:
        """Takes a block; one that was seen before is left out."""
        if last:
            self.end = seq
        if seq >= self.next:
            self.early[seq] = block
        while self.next in self.early:
            block = self.early.pop(self.next)
            self.data.push(block)
            self.instance.push(block)
            self.next += 1

    @property
    def whole(self) -> bool:
        return self.next == self.end + 1 and self.end >= 0

    def state(self) -> tuple:
        return (self.data.state(), self.instance.blake3.state(), self.next, self.end, self.early)

    def result(self) -> dict:
        return {"code_data": SCHEME + self.data.code(), "code_instance": SCHEME + self.instance.code(), "datahash": self.instance.multihash, "filesize": self.instance.filesize}


_NOTHING = {"code_data": None, "code_instance": None, "datahash": None, "filesize": None}


def stream_codes(blocks: DataFrame, ident: str, seq: str = "seq", block: str = "block", last: str = "last", timeout_seconds: int | None = None) -> DataFrame:
    """Codes of each asset as soon as all its blocks are there.  For streams; blocks that come again are left out.

    With timeout_seconds, an asset that gets no block for so long ends: with null codes, as it misses
    blocks.  So does a block that is repeated after its asset was whole, which opens the asset anew.
    """
    kind = blocks.schema[ident].dataType.simpleString()

    def take(key: tuple, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{ident: key[0]} | _NOTHING])
            return
        asset = _Asset(state.get if state.exists else None)
        for part in parts:
            for s, b, e in zip(part[seq], part[block], part[last], strict=True):
                asset.add(int(s), bytes(b), bool(e))
        if asset.whole:
            if state.exists:
                state.remove()
            yield pd.DataFrame([{ident: key[0]} | asset.result()])
        else:
            state.update(asset.state())
            if timeout_seconds:
                state.setTimeoutDuration(1000 * timeout_seconds)

    return blocks.groupBy(ident).applyInPandasWithState(take, f"`{ident}` {kind}, {_OUT}", _STATE, "append", "ProcessingTimeTimeout" if timeout_seconds else "NoTimeout")


def batch_codes(blocks: DataFrame, ident: str, seq: str = "seq", block: str = "block", last: str = "last") -> DataFrame:
    """The same over a table of blocks: one asset's blocks go by in order, none is held.  An asset that misses a block has null codes."""
    kind = blocks.schema[ident].dataType.simpleString()
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.select(ident, seq, block, last).repartition(n, ident).sortWithinPartitions(ident, seq)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, asset, done = None, None, True
        for batch in batches:
            for k, s, b, e in zip(batch[ident], batch[seq], batch[block], batch[last], strict=True):
                if asset is None or k != key:
                    if not done:
                        yield pd.DataFrame([{ident: key} | _NOTHING])
                    key, asset, done = k, _Asset(), False
                if done or s > asset.next:
                    continue  # a repeat; or a block before is missing, and what follows isn't held
                asset.add(int(s), bytes(b), bool(e))
                if asset.whole:
                    yield pd.DataFrame([{ident: key} | asset.result()])
                    done = True
        if not done:
            yield pd.DataFrame([{ident: key} | _NOTHING])

    return rows.mapInPandas(take, f"`{ident}` {kind}, {_OUT}")
