"""What the corpus operators share: staging in the cluster's shared folder, ranks at scale, column names."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where the public vocabulary files are looked up by name.
TOKENIZER_FILES = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import importlib

    return importlib.import_module(TOKENIZER_FILES).path(name)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or (unset, on one machine) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return (folder or _own_folder()).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back; later jobs start from these files.

    Cuts lineage: the rows outlive lost executors and are never computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Each thread has a value of its own, so runs side by side don't note (and drop) each other's tables.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting() -> Iterator[list[str]]:
    """Collects the paths that `stage` writes meanwhile in this thread, for whoever knows when they aren't needed any more."""
    made: list[str] = []
    before = _noted.set(made)
    try:
        yield made
    finally:
        _noted.reset(before)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """The column with exactly this name, dots and all."""
    return df[f"`{name}`"]


#: So many quantiles of a table's order are asked for; stretches between them hold about equal numbers of rows.
QUANTILES = 4096


def _stretch(value: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at most the value: first among every few of them, then between two of those."""
    step = max(1, math.isqrt(len(bounds)))
    upto = lambda some: F.size(F.filter(some, lambda b: b <= value))
    coarse = upto(F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]))
    return coarse * step + upto(F.slice(F.array(*[F.lit(b) for b in bounds]), coarse * step + 1, F.lit(step)))


def rank_in_group(df: DataFrame, group: list[str], order: str, ties: list[str], out: str, cell_rows: int = 500_000) -> DataFrame:
    """Number the rows of each group from 0 in the order of `order` (a long), then `ties`.

    A group can hold most of the rows, so no task sorts a whole group: the order is cut at
    quantiles into stretches of about `cell_rows` rows (32 to 4096 of them), wherever its values lie,
    each (group, stretch) is numbered by itself, and counts of the stretches before it are added: a
    table of stretches times groups, small enough to spare the rows a second shuffle. Stretches keep the
    order, so the numbers don't depend on how many there are. Null orders come first, in
    64 stretches by a hash of their ties. Rows equal in order and ties are numbered among each
    other freely. One value of `order` (an id or a place) is not expected to hold a large share of the rows.
    """
    n, found = df.agg(F.count(F.lit(1)), F.percentile_approx(order, [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES)).first()
    cells = max(32, min(QUANTILES, n // cell_rows))
    bounds = sorted(set((found or [])[QUANTILES // cells - 1 :: max(1, QUANTILES // cells)]))
    cell, before = fresh(df, "cell"), fresh(df, "before")
    nulls = F.pmod(F.xxhash64(*ties), F.lit(64)).cast("int") - 64
    cut = F.when(F.col(order).isNull(), nulls).otherwise(_stretch(F.col(order), bounds) if bounds else F.lit(0))
    rows = df.withColumn(cell, cut)
    counts = rows.groupBy(*group, cell).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    own = Window.partitionBy(*group, cell).orderBy(F.col(order).asc_nulls_first(), *ties)
    rows = rows.withColumn(out, F.row_number().over(own).cast("long") - 1)
    same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"c.`{c}`")) for c in [*group, cell]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    kept = [F.col(f"r.`{c}`") for c in df.columns]
    return rows.alias("r").join(counts.alias("c"), on).select(*kept, (F.col(f"r.{out}") + F.col(f"c.{before}")).alias(out))
