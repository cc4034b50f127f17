"""Rows numbered in one order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a task gets where rows are dealt out anew.
TASK_ROWS = 50_000


def tasks(rows: DataFrame) -> int:
    """How many tasks rows are dealt over: one for each core at least, and more of them as the rows grow, not larger ones. Counts the rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


#: Bounds between the stretches of the order, of which each is numbered by one task.
BOUNDS = 255


def numbered(rows: DataFrame, key: str, to: str, bounds: int = BOUNDS) -> DataFrame:
    """Adds the place of each row, from 1 on, in the order of a column whose values are distinct; null comes first.

    The keys of the smallest hashes are the bounds of stretches of about equal size, so
    that a task which runs again cuts alike. Stretches are counted, and each one's rows
    are numbered after those of the stretches before. Beyond the keys themselves only the
    bounds and as many counts are sent to every task.
    """
    drawn = rows.select(key).orderBy(F.xxhash64(key), key).limit(bounds)
    cuts = drawn.agg(F.array_sort(F.collect_list(key)).alias("_cuts"))
    # One row of at most as many keys as there are bounds.
    dealt = rows.join(F.broadcast(cuts)).withColumn("_stretch", F.size(F.filter("_cuts", lambda cut: cut < F.col(key)))).drop("_cuts")
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy("_stretch").agg(F.count("*").alias("_n")).select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy(key))
    return dealt.join(F.broadcast(begins), "_stretch").withColumn(to, (F.col("_before") + place).cast("int")).drop("_stretch", "_before")


def placed(rows: DataFrame, key: str, order: list[str], number: str, place: str, dealt_over: int | None = None, bounds: int = BOUNDS) -> DataFrame:
    """Adds the number of each row's key, from 1 on in the order of the keys, and the row's place among the rows of its key. Rows without a key go.

    The order of key and row is cut into stretches as in numbered, so that many rows of one
    key don't meet in one task; a row finds its stretch by halving.
    """
    rows = rows.withColumn("_at", F.struct(key, *order))
    cuts = rows.select("_at").orderBy(F.xxhash64("_at"), "_at").limit(bounds).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(bounds.bit_length()))))
    stretch = F.reduce(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col("_at"), at + step).otherwise(at))
    dealt = rows.join(F.broadcast(cuts)).withColumn("_stretch", stretch).drop("_cuts", "_at")
    if dealt_over:
        dealt = dealt.repartition(min(dealt_over, bounds + 1), "_stretch")
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_stretch", key).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    parts = parts.join(numbered(parts.select(key).distinct(), key, number), key)
    own = F.row_number().over(Window.partitionBy("_stretch", key).orderBy(*order))
    return dealt.withColumn("_own", own).join(parts, ["_stretch", key]).withColumn(place, (F.col("_before") + F.col("_own")).cast("int")).drop("_stretch", "_before", "_own")
