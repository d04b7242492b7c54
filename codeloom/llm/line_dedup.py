"""Removal of repeated runs of lines, cut by content.

A rolling hash over the last lines decides where a chunk ends, so chunks fall into step again after
an insertion or deletion.  Chunks of two lines and more that occur elsewhere are removed, except
where they come first.  Hashes only propose: chunks are compared byte by byte (the text itself is a
grouping key) before any is removed.

Hashes move for all chunks; texts only of those whose hash occurs twice.  Everything that is grouped
is summed up before the shuffle, so a chunk that a third of all documents hold is one row for each
task.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .storage import persisted

#: Fixed values of the cut: multiplier, modulus; and where not given, lines hashed together, one line in how many ends a chunk, and a chunk's least number of lines.
BASE, MODULUS, ROLL, AVERAGE, LEAST = 31, 1_000_003, 2, 2, 2


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _spaced(ends: Column) -> Column:
    """Of ascending numbers the first of each run of neighbours, and every other after it."""
    far = lambda a, b: F.coalesce(b - a > 1, F.lit(True))
    starts = F.filter(ends, lambda e, k: far(F.get(ends, k - 1), e))
    stops = F.filter(ends, lambda e, k: far(e, F.get(ends, k + 1)))
    return _let(stops, lambda t: F.flatten(F.transform(starts, lambda e, k: F.sequence(e, F.get(t, k), F.lit(2)))))


def _ends(lines: Column, average: int, roll: int, least: int) -> Column:
    """Numbers of the lines that end a chunk, ascending."""
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))

    def rolled(h: Column, i: Column) -> Column:
        total = F.lit(0).cast("long")
        for k in range(roll - 1, -1, -1):
            total = total * BASE + F.when(i >= k, F.get(h, i - k)).otherwise(F.lit(0))
        return total % MODULUS

    def ends(h: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (rolled(h, i) % average == 0) | (i == F.size(h) - 1))

    def apart(h: Column) -> Column:
        """The same with two lines a chunk at least: what stands before the text counts as an end, and one line that is left at last joins the chunk before it."""
        found = F.filter(F.sequence(F.lit(-1), F.size(h) - 2), lambda i: (i < 0) | (rolled(h, i) % average == 0))
        inner = F.filter(_let(found, _spaced), lambda e: (e >= 0) & (e < F.size(h) - 2))
        return F.concat(inner, F.array(F.size(h) - 1))

    return _let(hashes, ends if least == 1 else apart)


def _chunks(text: Column, average: int, roll: int, least: int) -> Column:
    """All chunks of two lines and more: number among the chunks, first line, lines, and two hashes of its text."""

    def of(lines: Column) -> Column:
        def each(ends: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
                return F.struct(k.alias("no"), start.alias("start"), (end - start + 1).alias("n"))

            return F.filter(F.transform(ends, one), lambda c: c["n"] > 1)

        def hashed(c: Column) -> Column:
            text = F.array_join(F.slice(lines, c["start"] + 1, c["n"]), "\n")
            return F.struct(c["no"].alias("no"), c["start"].alias("start"), c["n"].alias("n"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))

        return F.transform(_let(_ends(lines, average, roll, least), each), hashed)

    return _let(_lines(text), of)


def remove_repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", into: str = "deduped", average: int = AVERAGE, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """docs with a struct: n_lines, n_removed (lines), text (what is left, lines joined by line ends).

    Of equal chunks the one in the document of the least id stays (a null id is less than any; texts
    of the same id go by their hash), and within a document the first.  Rows equal in id and text
    count as one document and all keep or lose the same.  Null and empty texts are one empty line.
    Chunks of one line always stay, and so does a chunk whose hashes stand for two different texts.
    The column comes last, with underscores behind its name if docs has it.

    A chunk ends where the hash of the last roll lines is a multiple of average, and has least lines
    (1 or 2) if the text has.  The first roll - 1 lines of a passage are cut by what stands before
    it, and where least is 1 chunks of one line are never compared: a longer roll or average misses
    more of the passages that repeat (figures: README).
    """
    if least not in (1, 2) or average < 1 or roll < 1:
        raise ValueError("least is 1 or 2; average and roll are 1 at least")
    into = fresh(into, docs.columns)
    spark_rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash")).alias("doc"), F.col(text_col).alias("text"))
    every = persisted(spark_rows.select("doc", F.explode(_chunks(F.col("text"), average, roll, least)).alias("c")).select("doc", "c.*").distinct(), "chunks")
    # read from a table, so that the join can split a chunk that very many documents hold
    again = persisted(every.groupBy("h1", "h2", "n").agg(F.count("*").alias("times")).filter("times > 1").drop("times"), "again")
    proposed = persisted(every.join(again, ["h1", "h2", "n"]), "proposed")
    by_doc = proposed.groupBy("doc").agg(F.collect_list(F.struct("no", "start", "n", "h1", "h2")).alias("chunks"))  # at most a document's chunks
    texts = spark_rows.dropDuplicates(["doc"]).join(by_doc, "doc").select("doc", _lines(F.col("text")).alias("lines"), "chunks")
    texts = texts.select("doc", F.explode(F.transform("chunks", lambda c: F.struct(c["no"].alias("no"), c["n"].alias("n"), c["h1"].alias("h1"), c["h2"].alias("h2"), F.array_join(F.slice("lines", c["start"] + 1, c["n"]), "\n").alias("text")))).alias("c")).select("doc", "c.*")
    place = F.struct("doc", "no")
    equal = texts.groupBy("h1", "h2", "n", "text").agg(F.count("*").alias("times"), F.min(place).alias("first"))
    sure = equal.groupBy("h1", "h2", "n").agg(F.count("*").alias("texts"), F.first("times").alias("times"), F.first("first").alias("first")).filter("texts = 1 and times > 1")
    gone = proposed.join(persisted(sure, "repeated"), ["h1", "h2", "n"]).filter(place != F.col("first"))
    lost = gone.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("n") - 1)))).alias("lost"))
    doc, other = fresh("_doc", docs.columns), fresh("_lost", docs.columns)
    rows = docs.withColumn(doc, F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash")))
    rows = rows.join(lost.select(F.col("doc").alias(f"{doc}r"), F.col("lost").alias(other)), F.col(doc).eqNullSafe(F.col(f"{doc}r")), "left")
    # lines that go are marked by splicing what lies between them: the work grows with the lines, not with their square
    lines = _lines(F.col(text_col))

    def spliced(lost: Column) -> Column:
        def kept(x: Column) -> Column:
            bounds = F.concat(F.array(F.lit(-1)), lost, F.array(F.size(x)))
            pieces = _let(bounds, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda k: F.slice(x, F.get(b, k) + 2, F.get(b, k + 1) - F.get(b, k) - 1)))
            return F.array_join(F.flatten(pieces), "\n")

        return _let(lines, kept)

    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    result = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(other), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col(other).isNull(), whole).otherwise(_let(F.col(other), spliced)).alias("text"),
    )
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), result.alias(into))
