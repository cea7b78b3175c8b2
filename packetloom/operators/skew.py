"""Joins by a key of which a few values may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot with this part of all rows.
HOT = 1000


def join_counted(rows: DataFrame, keys: list[str], table: DataFrame, size: str, how: str = "inner") -> DataFrame:
    """Inner (or ``left_semi``) join of ``rows`` with a table of distinct ``keys`` that counts in ``size`` how many rows each has.

    Keys that hold more than a HOT-th of the counted rows, of which there are fewer than HOT, are broadcast to
    the rows; the others meet them in a join by key, where no key has more rows than that.  Both tables are
    read twice, so they should be written.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot, cold = F.broadcast(table.where(F.col(size) * HOT > total)), table.where(F.col(size) * HOT <= total)
    return rows.join(hot, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys, how))
