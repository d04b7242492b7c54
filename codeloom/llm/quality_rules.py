"""Quality rules learned as decision lists, and applied as Spark conditional expressions.

Statistics of a text are one DataFrame expression (no Python on executors).  From labelled
documents, sequential covering grows one rule after another: a conjunction of thresholds that grows
by the condition of the largest information gain, on two thirds of the rows that are left, until it
covers no good document; it is then pruned on the other third, and joins the list if it is precise
there.  The list becomes CASE WHEN ... in the order it was learned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
#: Labelled rows that the rules are learned from, at most (those with the least hashes of their ids).
MOST_LABELLED = 20_000


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once for each row, also where use reads it inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def _repeated(windows: Column) -> Column:
    """Words inside windows (given by their hashes) that are found twice or more."""

    def covered(places: Column) -> Column:
        return _sum(F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))).cast("long")))

    def places(ordered: Column) -> Column:
        same = lambda e, other: F.coalesce(e["x"] == other["x"], F.lit(False))
        found = F.transform(ordered, lambda e, i: F.when(same(e, F.get(ordered, i - 1)) | same(e, F.get(ordered, i + 1)), e["i"]))
        return _let(F.sort_array(F.array_compact(found)), covered)

    slow = lambda w: _let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), places)
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(slow(w)))


def _windows(hashes: Column) -> Column:
    n = F.size(hashes)
    each = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), each)).otherwise(F.array().cast("array<long>"))


def statistics(text: Column) -> Column:
    """Struct of counts of a text (null: empty), all long.  n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{BLANK}+"), "")
    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _repeated(_windows(h))).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return F.struct(
        by_words["n"].cast("long").alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        by_lines["d"].cast("long").alias("n_dup_lines"),
        by_words["r"].alias("n_repeat_words"),
        by_lines["n"].cast("long").alias("n_lines"),
        count(r"[A-Z]").alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[.,;:!?]").alias("n_marks"),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


#: What rules compare with thresholds: the name of each, and numerator and denominator among the statistics.
MEASURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
    "upper_case": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks_a_word": ("n_marks", "n_words"),
}


def measure(s: Column, name: str) -> Column:
    over, under = MEASURES[name]
    return s[over].cast("double") if under is None else s[over] / F.greatest(F.lit(1), s[under])


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # at least the threshold; else less
    threshold: float


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions."""

    conditions: tuple[Condition, ...]

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(values.values())))
        return np.logical_and.reduce([np.ones(n, dtype=bool), *((values[c.measure] >= c.threshold) == c.above for c in self.conditions)])

    def __str__(self) -> str:
        return " and ".join(f"{c.measure} {'>=' if c.above else '<'} {c.threshold:.6g}" for c in self.conditions)


def _best(values: dict[str, np.ndarray], bad: np.ndarray, candidates: int) -> tuple[float, Condition | None]:
    """The condition of the largest gain: bad rows it keeps, times how much surer it makes that a row is bad."""
    p, n = int(bad.sum()), int((~bad).sum())
    before, best = math.log2(p / (p + n)), (0.0, None)
    for name, v in values.items():
        order = np.argsort(v, kind="stable")
        ordered = v[order]
        cut = np.flatnonzero(ordered[1:] > ordered[:-1]) + 1
        if len(cut) > candidates:
            cut = cut[np.linspace(0, len(cut) - 1, candidates).astype(int)]
        below_bad = np.r_[0, np.cumsum(bad[order])][cut]
        for above in (True, False):
            kept_bad = p - below_bad if above else below_bad
            kept = len(v) - cut if above else cut
            with np.errstate(divide="ignore"):
                gain = np.where(kept_bad > 0, kept_bad * (np.log2(np.maximum(kept_bad, 1) / kept) - before), 0)
            if len(gain) and gain.max() > best[0] + 1e-12:
                k = int(np.argmax(gain))
                best = float(gain[k]), Condition(name, above, float((ordered[cut[k] - 1] + ordered[cut[k]]) / 2))
    return best


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, support: int = 3, candidates: int = 512) -> list[Rule]:
    """Sequential covering: rules for bad rows, each precise on the third that it wasn't grown on, with support bad rows there.  No bad rows, or only such: no rules."""
    left, rules = np.arange(len(bad)), []
    while len(rules) < most_rules:
        prune = np.arange(len(left)) % 3 == 2
        grow, held = left[~prune], left[prune]
        if bad[left].sum() < support or not bad[grow].any() or bad.all():
            break
        conditions: list[Condition] = []
        inside = grow
        while len(conditions) < most_conditions and not bad[inside].all():
            gain, best = _best({k: v[inside] for k, v in values.items()}, bad[inside], candidates)
            if best is None:
                break
            conditions.append(best)
            inside = inside[Rule((best,)).covers({k: v[inside] for k, v in values.items()})]
        if not conditions:
            break

        def worth(k: int, conditions=conditions, held=held) -> float:
            cover = Rule(tuple(conditions[:k])).covers({m: v[held] for m, v in values.items()})
            p, n = int((cover & bad[held]).sum()), int((cover & ~bad[held]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = Rule(tuple(conditions[: max(range(1, len(conditions) + 1), key=worth)]))
        cover = rule.covers({k: v[held] for k, v in values.items()})
        p, n = int((cover & bad[held]).sum()), int((cover & ~bad[held]).sum())
        if p < support or p < precision * (p + n):
            break
        rules.append(rule)
        left = left[~rule.covers({k: v[left] for k, v in values.items()})]
    return rules


def rejected(s: Column, rules: list[Rule]) -> Column:
    """The list as CASE WHEN: the number of the first rule that holds; null if none does."""
    out = None
    for k, rule in enumerate(rules):
        meets = F.lit(True)
        for c in rule.conditions:
            m = measure(s, c.measure)
            meets = meets & (m >= F.lit(c.threshold) if c.above else m < F.lit(c.threshold))
        out = F.when(meets, F.lit(k)) if out is None else out.when(meets, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def learn_from(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", most_labelled: int = MOST_LABELLED, **options) -> list[Rule]:
    """Rules from labelled documents that pass the base rule; a label of 0 is bad.  Rows without an id or a label don't count.

    At most most_labelled labels are used; more than enough for a few rules of few conditions, and
    the one bound on what the driver gets.
    """
    known = labels.select(F.col(label_id).cast("long").alias("k"), F.col(label).cast("int").alias("y")).dropna().groupBy("k").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(most_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).join(F.broadcast(known), "k")
    rows = rows.select("k", "y", statistics(F.col("t")).alias("s")).filter(~base_failed(F.col("s")))
    got = sorted(rows.select("k", "y", *(measure(F.col("s"), m).alias(m) for m in MEASURES)).orderBy(F.xxhash64("k"), "k").limit(most_labelled).collect(), key=lambda r: tuple(r)[::-1])
    order = np.random.default_rng(5).permutation(len(got))
    got = [got[i] for i in order]
    return learn_rules({m: np.array([r[m] for r in got], dtype=float) for m in MEASURES}, np.array([r["y"] == 0 for r in got], dtype=bool), **options)


def judge(docs: DataFrame, rules: list[Rule], *, text_col: str = "text", into: str = "quality") -> DataFrame:
    """docs with a struct: stats (see statistics), base_failed, rule (number of the rule that rejects it, or null), kept.

    Null, empty and blank texts have no words and fail the base rule.  Rows are judged one by one.
    The column comes last, with underscores behind its name if docs has it.
    """
    name, held = fresh(into, docs.columns), fresh("_stats", docs.columns)
    rows = docs.withColumn(held, statistics(F.col(text_col)))
    s = F.col(held)
    verdict = F.struct(s.alias("stats"), base_failed(s).alias("base_failed"), rejected(s, rules).alias("rule"), (~base_failed(s) & rejected(s, rules).isNull()).alias("kept"))
    return rows.withColumn(name, verdict).drop(held)
