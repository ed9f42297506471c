"""Names of columns: quoting, and working names that no column of the caller has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """For each of ``wanted`` a name that is in ``taken`` in no spelling, nor given twice."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        k, free = 0, name
        while free.lower() in used:
            k += 1
            free = f"{name}_{k}"
        used.add(free.lower())
        out.append(free)
    return out
