"""One search from records to exports and report, stage by stage, each written under its run date."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import buyers as B
from ..operators import exports, judging, report, resolve, sites, verdicts
from ..operators.purchases import kept_awards, purchase_export
from ..sources.listings import census_rows
from ..sources.registry import discovered, status_of  # noqa: F401 - part of a run
from .settings import Profile, Search

LOG = "source string, status string, count long, error string"


@dataclass(frozen=True)
class Outcome:
    """What a run wrote, its report's text, its cell in the index, and how many rows each step left."""

    delivered: DataFrame
    text: str
    cell: str = ""
    counts: dict[str, int] = field(default_factory=dict)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_records(spark: SparkSession, records: DataFrame | None, log: report.Log, root: str, name: str, run_date: str) -> None:
    """A search's records and the log of its sources; a search without records leaves the log alone."""
    day = F.lit(run_date).cast("date")
    exports.write_stage(spark.createDataFrame(log, LOG).coalesce(1).withColumn("run_date", day), f"{root}/{name}", "sources")
    if records is not None:
        exports.write_stage(records.withColumn("run_date", day), f"{root}/{name}", "records")


def saved_records(spark: SparkSession, root: str, name: str, run_date: str) -> DataFrame | None:
    """The day's records: with their sites where the enrich stage ran, else as discovered, or none."""
    for stage in ("enriched", "records"):
        if there(spark, f"{root}/{name}/{stage}/run_date={run_date}"):
            return exports.read_stage(spark, f"{root}/{name}", stage, run_date).drop("run_date")
    return None


def saved_log(spark: SparkSession, root: str, name: str, run_date: str) -> report.Log:
    if not there(spark, f"{root}/{name}/sources/run_date={run_date}"):
        return []
    return [tuple(r) for r in exports.read_stage(spark, f"{root}/{name}", "sources", run_date).select("source", "status", "count", "error").orderBy("source").collect()]  # one row a source


def with_websites(spark: SparkSession, records: DataFrame, hits: DataFrame, root: str, name: str, run_date: str) -> DataFrame:
    """The day's records with websites from search hits where they had none, written in their stage and read back."""
    found = sites.find_websites(records, hits).withColumn("run_date", F.lit(run_date).cast("date"))
    exports.write_stage(found, f"{root}/{name}", "looked_up")
    return exports.read_stage(spark, f"{root}/{name}", "looked_up", run_date).drop("run_date")


def census_counts(search: Search, payloads: DataFrame) -> dict[str, Any]:
    """What the census (payload: its answers) counts for a search's coverage block, as the report's coverage line takes it; a failure is part of it."""
    own = search.coverage
    told = {"year": int(own.get("year", 2022)), "codes": [str(c) for c in own.get("naics") or []], "counties": sum(len(v) for v in (own.get("counties") or {}).values())}
    if not told["codes"] or not told["counties"]:
        return told | {"status": "failed", "error": "coverage needs industry codes and counties"}
    rows = census_rows(payloads)
    asked = rows.filter(F.col("naics").isin(told["codes"]))
    found = B.coverage(asked).filter("naics is null").first()
    return told | {"status": "ok", "total": found["total"] if found else 0, "under_20": found["under_20"] if found else 0}


def save_sites(spark: SparkSession, settings: Profile, name: str, records: DataFrame, pages: DataFrame, scripts: DataFrame | None, root: str, run_date: str) -> tuple[int, int]:
    """Read websites from staged pages under the search's budget; returns how many were read and failed."""
    own = settings[name]
    rows = sites.read_sites(
        records, pages, own.policy.region, own.max_sites, own.max_pages, scripts, own.max_scripts
    )
    exports.write_stage(rows.withColumn("run_date", F.lit(run_date).cast("date")), f"{root}/{name}", "enriched")
    counts = sites.reading_counts(exports.read_stage(spark, f"{root}/{name}", "enriched", run_date)).first()
    return counts["sites_read"], counts["sites_failed"]


def _ranked(search: Search, records: DataFrame, run_date: str, history: DataFrame | None = None) -> DataFrame:
    return A.ranked(A.evaluated(resolve.accounts(records), search.policy, F.lit(run_date).cast("date"), history))


def judge_sizes(spark: SparkSession, settings: Profile, name: str, records: DataFrame, run_date: str) -> list[Any]:
    """A dry run of the judge: part, parts, accounts and characters of each batch."""
    queue = _ranked(settings[name], records, run_date).filter("passed").orderBy("rank").limit(settings[name].judge_limit)
    sized = judging.batch_texts(queue).select("part", "parts", F.size(F.split("body", "\n")).alias("accounts"), F.length("body").alias("characters"))
    return sized.orderBy("part").collect()  # one row a batch


def run_search(spark: SparkSession, settings: Profile, name: str, records: DataFrame, run_date: str, root: str, decisions: DataFrame | None = None, headings: list[str] | None = None, purchases: DataFrame | None = None, log: report.Log | None = None, census: dict[str, Any] | None = None) -> Outcome:
    """Resolve, filter, rank, apply decisions, match purchases, export and report one search."""
    search, day = settings[name], F.lit(run_date).cast("date")
    history = None
    if search.suppresses and there(spark, f"{root}/runs"):  # the first run has no history
        history = exports.recent_names(spark.read.schema(exports.RUNS).parquet(f"{root}/runs"), settings.window, run_date)
    seen = {k: Observation() for k in ("records", "accounts", "delivered")}  # counted by the jobs that write, not by jobs of their own
    count = F.count(F.lit(1)).alias("n")
    records = records.observe(seen["records"], count)
    exports.write_stage(_ranked(settings[name], records, run_date, history).observe(seen["accounts"], count).withColumns({"run_date": day, "search": F.lit(name)}), f"{root}/{name}", "accounts")
    ranked = exports.read_stage(spark, f"{root}/{name}", "accounts", run_date)
    goal, target = search.goal, search.target
    kept = rejected = None
    if decisions is not None:
        queue = ranked.filter("passed").orderBy("rank").limit(settings[name].judge_limit)
        kept, rejected, _ = verdicts.enforced(queue, decisions, headings or [], search.drafts, search.wanted)
    none = spark.createDataFrame([], "account_id string, fit string, fit_score int")
    if goal == "top_n":
        delivered = verdicts.deliver_top(ranked, kept, target)
    else:
        delivered = verdicts.deliver_map(ranked, kept if kept is not None else none, rejected if rejected is not None else none)
    if kept is not None:
        more = kept.select("account_id", "what_they_do", "why_fit", "risks", F.col("signals").alias("judge_signals"), "contact_role", "draft")
        delivered = delivered.join(more, "account_id", "left")
    exports.write_csv(exports.account_export(delivered), f"{root}/{name}/exports/{run_date}/accounts")
    if kept is not None:
        exports.write_csv(exports.draft_export(delivered, run_date, name), f"{root}/{name}/exports/{run_date}/queue", only_if_rows=True)
    rows = None
    if purchases is not None:
        listed = delivered.select("account_id", "name", F.col("place").alias("pos"))
        if "payload" in purchases.columns:  # saved answers of the award service
            found = kept_awards(purchases, listed, search.most_awards)
        else:
            matched = purchases.join(B.match_vendors(purchases, listed).withColumnRenamed("account_id", "vendor_account_id"), "vendor", "left")
            found = B.own_lookups(matched)
        rows = B.labelled(found, listed)
        exports.write_csv(purchase_export(rows), f"{root}/{name}/exports/{run_date}/purchases", only_if_rows=True)
    exports.save_run(delivered.select(day.alias("run_date"), F.lit(name).alias("search"), F.col("place").alias("rank"), "name").observe(seen["delivered"], count), root)
    counts = {k: o.get["n"] for k, o in seen.items()}
    funnel = exports.funnel_line(ranked, counts["records"], kept, rejected)
    notes = [report.coverage_text(census, counts["delivered"]), report.tools_text(ranked)]
    text = report.section(search.label, goal, funnel, delivered, rows, judged=kept is not None, target=target, notes=notes, log=log, rejected=rejected)
    today = spark.read.schema(exports.RUNS).parquet(f"{root}/runs").filter((F.col("run_date") == day) & (F.col("search") == name))
    cell = exports.index_cells(today).first()
    return Outcome(delivered, text, cell["cell"] if cell else "", counts)
