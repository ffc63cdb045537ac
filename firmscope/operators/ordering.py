"""Numbers of rows in an order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def numbered(df: DataFrame, order: list[Column], out: str, by: list[str] | None = None) -> DataFrame:
    """Adds `out`, each row's number from 1 in that order; with `by`, each group is numbered by itself, however large it is.

    Rows are dealt to ranges of the order and written, each range numbers its own rows, and the counts of the
    ranges before it are added: a table of ranges times groups. The order must settle all ties.
    """
    by = by or []
    own = [F.col(b) for b in by]
    ranged = df.repartitionByRange(*[c.asc_nulls_first() for c in own], *order).withColumn("_range", F.spark_partition_id())
    rows = staged(ranged, "ranges")
    before = Window.partitionBy(*own, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*own, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = F.col("_range") == F.col("_of")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = F.row_number().over(Window.partitionBy(*own, "_range").orderBy(*order))
    placed = rows.withColumn(out, inside).join(starts, on)
    return placed.withColumn(out, (F.col(out) + F.col("_start")).cast("int")).select(*df.columns, out)
