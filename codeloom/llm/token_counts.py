"""Exact token counts at every prefix of a text, by dynamic programming over its units.

The tokenizer is a sentencepiece BPE whose pieces hold the space mark only at their front or as a
run of nothing else, so no merge crosses from another character to a space mark: a text's tokens
are those of its units (a run of spaces with the other characters up to the next space) one after
the other.  With cost(u) the count of unit u,

    count(end of unit k)      = count(end of unit k - 1) + cost(unit k)
    count(i inside of unit k) = count(end of unit k - 1) + cost(unit k's first characters up to i)

which gives the count the library would return for text[:i], for every i, from a table of units'
prefixes; truncation to a budget reads that array and encodes nothing again.  The count of a whole
text, whether it is over a limit, and where the limit cuts it are read from the array, too: from its
entries at the ends of units, and from those inside of the one unit that the limit falls in.
Whether the tokenizer has the property is tested when it is loaded; without it, whole texts are encoded.

Inside of a unit the counts are by dynamic programming, too.  Merges go by the score of what they
make, so a row of tokens is the library's encoding just if that holds for each two neighbours; hence
the encoding of u[:j] ends in the one token t before j that may follow the last token of u[:j - len(t)]:

    cost(u[:j]) = cost(u[:j - len(t)]) + cost(t)

That is one step for each character and each length of a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, held, tokenizer_file, with_arrow

MARK = "▁"
_UNIT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
_MOST_KEPT = 400_000
#: Characters of the longest unit whose prefixes' counts are kept for the next text.
_LONGEST_KEPT = 200


class PrefixCounter:
    """Counts tokens of texts and of all their prefixes with one sentencepiece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.units_stand_alone = all(set(p) == {MARK} or MARK not in p[1:] for p in pieces) and self._keeps_text()
        self.costs: dict[str, int] = {}
        self.prefix_costs: dict[str, np.ndarray] = {}
        m, ids = self.model, range(self.model.get_piece_size())
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        long = [s for p, s in self.scores.items() if len(p) > 1 and set(p) != {MARK}]
        self.steps = self.units_stand_alone and sum(map(m.is_byte, ids)) == 256 and len(set(long)) == len(long)
        self.longest = max(map(len, self.scores))
        self.wholes: dict[str, bool] = {}
        self.follows: dict[tuple[str, str], bool] = {}

    def _keeps_text(self) -> bool:
        """That the model changes no characters and keeps every space, but for the one it puts in front."""
        probe = "a  b 　cﬁ d\t\né "
        return self.model.decode(self.model.encode(probe)) == probe and self.model.encode("a b") == self.model.encode(f"a{MARK}b")

    def _encode_lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def _unit_lengths(self, units: list[str]) -> list[int]:
        """The model puts a space in front of what it gets, and each unit begins with one; but from nothing it makes no token."""
        return [max(1, n) for n in self._encode_lengths([u[1:] for u in units])]

    def _learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.costs]
        if len(self.costs) + len(new) > _MOST_KEPT:
            self.costs.clear()
            new = list(units)
        self.costs.update(zip(new, self._unit_lengths(new), strict=True))

    def _units(self, text: str) -> list[str]:
        return _UNIT.findall(f" {text}") if text else []

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        if not self.units_stand_alone:
            return self._encode_lengths(texts)
        return [int(x[-1]) if len(x) else 0 for x in self.running_counts(texts)]

    def running_counts(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the counts at the ends of its units, ascending; the last is that of the whole text."""
        if not self.units_stand_alone:
            return [np.array([n]) for n in self._encode_lengths(texts)]
        out = []
        for text in texts:
            units = self._units(text)
            try:
                costs = [*map(self.costs.__getitem__, units)]
            except KeyError:
                self._learn(set(units))
                costs = [*map(self.costs.__getitem__, units)]
            out.append(np.cumsum(costs, dtype=np.int64))
        return out

    def _merged(self, text: str) -> list[str]:
        """Tokens of a short text, with nothing put in front: the best merge first, and of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.scores.get(a + b, -np.inf) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            best = max(scores)
            if best == -np.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _may_end(self, token: str) -> bool:
        """Whether token is one that encodings have."""
        if (found := self.wholes.get(token)) is None:
            found = self.wholes[token] = token in self.scores and self._merged(token) == [token]
        return found

    def _may_follow(self, before: str, token: str) -> bool:
        if (found := self.follows.get((before, token))) is None:
            if len(self.follows) > _MOST_KEPT:
                self.follows.clear()
            found = self.follows[before, token] = self._merged(before + token) == [before, token]
        return found

    def _stepped(self, unit: str) -> np.ndarray | None:
        """cost(unit[:j]) for j = 0 to len(unit), by the last token of each; None where there isn't one."""
        unit = unit.replace(" ", MARK)
        last, cost = [""], [0]
        for j in range(1, len(unit) + 1):
            for n in range(min(j, self.longest), 0, -1):
                token = unit[j - n : j]
                if (n == 1 or (token in self.scores and self._may_end(token))) and (j == n or self._may_follow(last[j - n], token)):
                    last.append(token)
                    cost.append(cost[j - n] + (1 if token in self.scores else len(token.encode())))
                    break
            else:
                return None
        return np.array(cost, dtype=np.int32)

    def _unit_prefixes(self, unit: str) -> np.ndarray:
        """cost(unit[:j]) for j = 0 to len(unit); cost of nothing is 0."""
        if (found := self.prefix_costs.get(unit)) is None:
            if len(self.prefix_costs) > _MOST_KEPT // 8:
                self.prefix_costs.clear()
            found = self._stepped(unit) if self.steps else None
            if found is None or found[-1] != self._unit_lengths([unit])[0]:
                found = np.array([0, *self._unit_lengths([unit[:j] for j in range(1, len(unit) + 1)])], dtype=np.int32)
            if len(unit) <= _LONGEST_KEPT:
                self.prefix_costs[unit] = found
        return found

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i: tokens of text[:i], for i = 0 to len(text)."""
        if not self.units_stand_alone:
            return np.array(self._encode_lengths([text[:i] for i in range(len(text) + 1)]), dtype=np.int32)
        out, at, before = np.zeros(len(text) + 2, dtype=np.int32), 0, 0
        for unit in self._units(text):
            costs = self._unit_prefixes(unit)
            out[at + 1 : at + len(unit) + 1] = before + costs[1:]
            at, before = at + len(unit), before + int(costs[-1])
        out[1] = 0  # the space in front alone: no text, no token
        return out[1:]

    def cut(self, text: str, budget: int, running: np.ndarray | None = None) -> int:
        """Characters of the longest prefix of at most budget tokens.  Of the array of prefix counts only the entries inside the unit that the budget falls in are worked out."""
        if budget < 0:
            return 0
        if not self.units_stand_alone:
            return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])
        running = self.running_counts([text])[0] if running is None else running
        if not len(running) or running[-1] <= budget:
            return len(text)
        units = self._units(text)
        k = int(np.searchsorted(running, budget, side="right"))  # the first unit that doesn't fit whole
        costs = self._unit_prefixes(units[k]) + (int(running[k - 1]) if k else 0)
        inside = int(np.flatnonzero(costs <= budget)[-1])
        if not k and not inside:
            inside = 1  # the space in front alone: no text, no token
        return sum(map(len, units[:k])) + inside - 1

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most budget tokens."""
        return text[: self.cut(text, budget)]


def counter(model: str) -> PrefixCounter:
    return held(("counter", model), lambda: PrefixCounter(tokenizer_file(model)))


def count_tokens(docs: DataFrame, *, text_col: str = "text", model: str = "piece_bpe_32k.model", into: str = "n_tokens", prefixes_into: str | None = None, budget: int | None = None, truncated_into: str = "truncated", limit: int | None = None, over_into: str = "over_limit", cut_into: str = "limit_chars") -> DataFrame:
    """docs with the token count of the whole text; on request also the counts at all prefixes (array), the longest prefix within budget, and whether the text has more than limit tokens and how many of its characters are within.

    Null and empty texts have 0 tokens (and a null truncated text for null).  No begin, end or
    added special tokens; special tokens' strings inside a text are ordinary text.  Rows are judged
    one by one, so ties and repeated rows need no rule.  Very long texts are counted whole, in time
    that grows with their length, also where they are a single word.  New columns come last and get
    underscores if docs has their names.  One pass, no shuffle; memory holds one Arrow batch and a
    bounded table of units.
    """
    taken, added = list(docs.columns), []

    def add(name: str, kind: T.DataType) -> None:
        added.append(T.StructField(fresh(name, taken), kind))
        taken.append(added[-1].name)

    add(into, T.LongType())
    if prefixes_into:
        add(prefixes_into, T.ArrayType(T.IntegerType()))
    if budget is not None:
        add(truncated_into, T.StringType())
    if limit is not None:
        add(over_into, T.BooleanType())
        add(cut_into, T.LongType())

    def count(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            raw = batch.column(at).to_pylist()
            texts = [x or "" for x in raw]
            running = c.running_counts(texts)
            new = [pa.array([int(x[-1]) if len(x) else 0 for x in running], pa.int64())]
            if prefixes_into:
                new.append(pa.array([c.prefix_counts(x) for x in texts], pa.list_(pa.int32())))
            if budget is not None:
                new.append(pa.array([None if r is None else r[: c.cut(r, budget, x)] for r, x in zip(raw, running, strict=True)], pa.string()))
            if limit is not None:
                cuts = [c.cut(t, limit, x) for t, x in zip(texts, running, strict=True)]
                new.append(pa.array([n < len(t) for n, t in zip(cuts, texts, strict=True)], pa.bool_()))
                new.append(pa.array(cuts, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f"a{i}" for i in range(len(new)))])

    return with_arrow(docs, text_col, count, added)
