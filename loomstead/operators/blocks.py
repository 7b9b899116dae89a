"""What depends on the row before, computed in blocks of a sequence and carried from block to block.

A sequence of any length is shared between tasks: only one small row of each block is put in order as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a sequence that are put in order together.
BLOCK = 65_536


def block(place: Column) -> Column:
    """The block of a place; places that are null are before all others."""
    return F.coalesce(F.floor(place / BLOCK), F.lit(-1))


def runs(df: DataFrame, key: list[str], blocks: list[str], order: list[str], value: str, starts: Callable[[Column, Column], Column]) -> DataFrame:
    """Add `prev`, the value of the row before in the sequence (null for the first), and `nth`, how many rows up to this one start something.

    key: the sequence; blocks: columns that cut it, in order; order: the order of rows in a block; starts(prev, value).
    """
    inside = Window.partitionBy(*key, *blocks).orderBy(*order)
    first = F.row_number().over(inside) == 1
    prev = F.lag(value).over(inside)
    own = df.withColumn("_first", first).withColumn("prev", prev)
    begun = F.when(F.col("_first"), 0).otherwise(starts(F.col("prev"), F.col(value)).cast("int"))
    own = own.withColumn("_begun", begun).withColumn("_n", F.sum("_begun").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = own.groupBy(*key, *blocks).agg(
        F.max(F.when(F.col("_first"), F.col(value))).alias("_head"), F.max_by(value, F.struct(*order)).alias("_tail"), F.sum("_begun").alias("_total")
    )
    over = Window.partitionBy(*key).orderBy(*blocks)
    ends = ends.withColumn("_before", F.lag("_tail").over(over))
    ends = ends.withColumn("_new", F.coalesce(starts(F.col("_before"), F.col("_head")).cast("int"), F.lit(1)))
    upto = F.coalesce(F.sum(F.col("_total") + F.col("_new")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(*key, *blocks, "_before", (upto + F.col("_new")).alias("_upto"))
    joined = own.join(ends, [*key, *blocks]).withColumn("prev", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("prev")))
    return joined.withColumn("nth", F.col("_upto") + F.col("_n")).drop("_first", "_begun", "_n", "_before", "_upto")
