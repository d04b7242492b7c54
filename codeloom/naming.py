"""Names of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with underscores behind it until no taken column has it (column names ignore case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def exactly(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")
