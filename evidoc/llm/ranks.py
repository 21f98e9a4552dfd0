"""Gapless ranks within groups, without a task that holds a whole group.

Rows of a group are dealt to cells by a hash of the row; a cell is ranked by a window of its own and
starts at the number of rows in the cells before it. The number of cells grows with the group, so a
group that holds a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell that the choice of cells aims at.
CELL_ROWS = 1_000


def cells(count: Column) -> Column:
    """How many cells a group of ``count`` rows is dealt to."""
    return (F.lit(1) + F.floor(count / F.lit(CELL_ROWS))).cast("long")


def within(df: DataFrame, group: Sequence[str], cell: str, order: Sequence[Column], out: str) -> DataFrame:
    """Append ``out``: 0, 1, ... within each group, ordered by cell and then by ``order``.

    ``cell`` is an integer column that deals a group's rows evenly. Rows that tie in ``order`` take
    any of their ranks; ranks stay gapless.
    """
    first = "__first"
    sizes = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *group, cell, F.coalesce(F.sum("__rows").over(before), F.lit(0)).cast("long").alias(first)
    )
    own = Window.partitionBy(*group, cell).orderBy(*order)
    ranked = df.withColumn("__own", F.row_number().over(own).cast("long") - 1)
    return ranked.join(starts, [*group, cell]).withColumn(out, F.col(first) + F.col("__own")).drop(first, "__own")
