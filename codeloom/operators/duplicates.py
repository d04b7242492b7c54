"""Exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..naming import exactly, fresh


def _digest(content: Column | str) -> Column:
    return F.sha2((exactly(content) if isinstance(content, str) else content).cast("binary"), 256)


def duplicate_groups(df: DataFrame, ident: str, content: Column | str) -> DataFrame:
    """Of contents that occur more than once: digest (SHA-256), n, first (least id).  Null contents don't count."""
    rows = df.select(exactly(ident).alias("i"), _digest(content).alias("digest")).filter("digest is not null")
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("i").alias("first")).filter("n > 1")


def mark_duplicates(df: DataFrame, ident: str, content: Column | str, into: str = "duplicate_of") -> DataFrame:
    """df with the least id among rows of equal content; null in that row itself, without copies, and for null contents.

    If df has a column named as ``into``, underscores are added to the new one's name.  Rows of null
    content are dealt by their id, so they don't meet in one task.
    """
    digest, first, into = fresh("digest", df.columns), fresh("first", df.columns), fresh(into, df.columns)
    rows = df.withColumn(digest, F.coalesce(_digest(content), F.concat(F.lit("null "), F.hash(exactly(ident)).cast("string"))))
    groups = duplicate_groups(df, ident, content).select(F.col("digest").alias(digest), F.col("first").alias(first))
    joined = rows.join(groups, digest, "left")
    return joined.select(*(exactly(c) for c in df.columns), F.when(exactly(ident) > F.col(first), F.col(first)).alias(into))


def _against(df: DataFrame, known: DataFrame, content: str, known_content: str, how: str) -> DataFrame:
    digest = fresh("digest", df.columns)
    have = known.select(_digest(known_content).alias(digest)).filter(F.col(digest).isNotNull()).distinct()
    return df.withColumn(digest, _digest(content)).join(have, digest, how).select(*(exactly(c) for c in df.columns))


def unknown_content(df: DataFrame, known: DataFrame, content: str, known_content: str) -> DataFrame:
    """Rows whose content isn't in known (null contents stay)."""
    return _against(df, known, content, known_content, "left_anti")


def known_content(df: DataFrame, known: DataFrame, content: str, known_content: str) -> DataFrame:
    """Rows whose content is in known."""
    return _against(df, known, content, known_content, "left_semi")
