"""The same rules over streams: signal windows with late data, first sightings, running purchase totals.

Each query reads a table as a stream of files until there is no more, with its state and
progress in the folder all machines share, and returns what it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging
from ..session import table


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, as the table may be one file or a folder


def _folder(spark: SparkSession) -> str:
    return f"{staging.folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(out: DataFrame, mode: str = "append") -> DataFrame:
    """Everything there is, once, to files; the progress log makes a restart exactly-once."""
    at = _folder(out.sparkSession)
    q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/progress").option("path", f"{at}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{at}/rows")


def signal_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events of each kind per window; windows close once the watermark has passed them."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def first_sightings(events: DataFrame, within: str = "60 days") -> DataFrame:
    """A user's first event of each kind within the watermark; later ones are suppressed."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def stream_signal_windows(spark, sf_dir):
    """Closed windows alone: the last day stays open as no later event closes it."""
    rows = _run(signal_windows(_stream(spark, sf_dir, "events")))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_first_sightings(spark, sf_dir):
    return _run(first_sightings(_stream(spark, sf_dir, "events")))


def stream_purchases(spark, sf_dir):
    """Buyers' totals kept up batch by batch: each batch adds its partial sums, and the parts are summed when read."""
    at = _folder(spark)

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
        part.write.mode("overwrite").parquet(f"{at}/parts/batch={number}")  # a batch that runs again replaces its own part

    q = _stream(spark, sf_dir, "lineitem").writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/parts").groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(18,2)").alias("total"))


def running_totals(awards: DataFrame, within: str = "3650 days") -> DataFrame:
    """A buyer's awards and their total so far, from a stream of award, buyer, at, amount in any order; an award that comes again within the watermark counts once.

    State is a key an award until the watermark has passed it, and a row a buyer; in update mode each batch gives the buyers that it changed.
    """
    once = awards.withWatermark("at", within).dropDuplicatesWithinWatermark(["award"])
    return once.groupBy("buyer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total"))


def kept_up(totals: DataFrame, at: str) -> DataFrame:
    """Runs the totals in update mode and returns each buyer's newest row; a batch that runs again replaces its own rows."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/changes/batch={number}")

    q = totals.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    changes = totals.sparkSession.read.parquet(f"{at}/changes")
    rest = [c for c in totals.columns if c != "buyer"]
    newest = changes.groupBy("buyer").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select("buyer", "r.*")


def stream_award_totals(spark, sf_dir):
    """All orders as awards; every third comes twice and every fifth a second time as well."""
    o = _stream(spark, sf_dir, "orders")
    again = F.sequence(F.lit(1), F.lit(1) + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0) + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    awards = o.select(F.col("o_orderkey").alias("award"), F.col("o_custkey").alias("buyer"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("amount"), F.explode(again).alias("copy")).drop("copy")
    return kept_up(running_totals(awards), _folder(spark))


QUERIES = {f.__name__: f for f in (stream_signal_windows, stream_first_sightings, stream_purchases, stream_award_totals)}
ORACLE = {
    "stream_signal_windows": """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY ALL)
        SELECT day, event_type, n, total FROM d WHERE CAST(day AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_first_sightings": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_award_totals": "SELECT o_custkey AS buyer, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey",
    "stream_purchases": "SELECT l_suppkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY l_suppkey",
}
