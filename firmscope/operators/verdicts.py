"""Outside keep-or-reject decisions, checked before they count, and what is delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered

# Texts that stand in results where a decision lacks them.
NO_DECISION = "No decision returned by the judge; review by hand."
NO_REASON = "Rejected without a stated reason."
NO_DESCRIPTION = "Unverified: no description returned."
NO_RISKS = "The judge stated no risks; review before any outreach."
BELOW = "Qualified, but ranked below the top {}."

DECISION = """account_id string, decision string, reject_reason string, fit string, fit_score int, what_they_do string,
  why_fit array<struct<text:string,context_id:string>>, signals array<struct<detail:string,url:string>>, risks array<string>, contact_role string,
  draft struct<channel:string,subject:string,body:string>"""


def known_citation(ident: Column, headings: list[str]) -> Column:
    """Whether the id, or a part of it between " / ", is a heading of the context."""
    known = F.array(*[F.lit(h) for h in headings]) if headings else F.array().cast("array<string>")
    parts = F.transform(F.split(F.trim(F.coalesce(ident, F.lit(""))), " / "), lambda p: F.trim(p))
    return F.array_contains(known, F.trim(F.coalesce(ident, F.lit("")))) | F.exists(parts, lambda p: F.array_contains(known, p))


def enforced(queue: DataFrame, decisions: DataFrame, headings: list[str], drafts: bool, target: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, rejected, stats) of a queue (account_id, name, rank) and decisions (pos and DECISION).

    One decision an account, the first; none is a rejection; unknown accounts are counted and ignored.
    Points that cite no known heading go. Scores are held to 1..5. With a target the rest is rejected.
    """
    known = decisions.join(queue.select("account_id"), "account_id", "left_semi")
    first = known.groupBy("account_id").agg(F.min_by(F.struct(*[c for c in decisions.columns if c not in ("account_id", "pos")]), "pos").alias("d"))
    q = queue.select("account_id", "name", "rank").join(first, "account_id", "left")
    no = F.col("d").isNull() | (F.col("d.decision") == "reject") | ~F.coalesce(F.col("d.fit").isin("strong", "possible"), F.lit(False))
    reason = F.when(F.col("d").isNull(), NO_DECISION).otherwise(F.coalesce(F.nullif("d.reject_reason", F.lit("")), F.lit(NO_REASON)))
    rejected = q.filter(no).select("account_id", "name", "rank", reason.alias("reason"))
    why = F.filter(F.coalesce("d.why_fit", F.array().cast("array<struct<text:string,context_id:string>>")), lambda w: known_citation(w["context_id"], headings))
    risks = F.filter(F.coalesce("d.risks", F.array().cast("array<string>")), lambda r: F.trim(r) != "")
    score = F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.nullif("d.fit_score", F.lit(0)), F.lit(1))))
    can = F.lit(drafts) & (F.col("d.fit") == "strong") & F.coalesce(F.col("d.draft.channel") != "none", F.lit(False)) & (F.coalesce("d.draft.body", F.lit("")) != "")
    kept = q.filter(~no).select(
        "account_id", "name", "rank", F.col("d.fit").alias("fit"), score.alias("fit_score"), F.coalesce(F.nullif("d.what_they_do", F.lit("")), F.lit(NO_DESCRIPTION)).alias("what_they_do"),
        why.alias("why_fit"), F.filter("d.signals", lambda s: F.coalesce(s["detail"], F.lit("")) != "").alias("signals"),
        F.when(F.size(risks) > 0, risks).otherwise(F.array(F.lit(NO_RISKS))).alias("risks"),
        F.nullif(F.trim("d.contact_role"), F.lit("")).alias("contact_role"), F.when(can, F.col("d.draft").withField("body", F.left("d.draft.body", F.lit(1200)))).alias("draft"),
        (F.size(F.coalesce("d.why_fit", F.array().cast("array<struct<text:string,context_id:string>>"))) - F.size(why)).alias("uncited"),
    )
    kept = kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fit_score"), "rank")))  # a queue has a few hundred accounts at most
    stats = kept.agg(F.coalesce(F.sum("uncited"), F.lit(0)).alias("uncited_points_removed")).crossJoin(q.agg(F.count_if(F.col("d").isNull()).alias("missing_decisions"))).crossJoin(
        decisions.join(queue, "account_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_ids_ignored"))
    )
    if target:
        below = kept.filter(F.col("place") > target).select("account_id", "name", "rank", F.lit(BELOW.format(target)).alias("reason"))
        kept, rejected = kept.filter(F.col("place") <= target), rejected.unionByName(below)
    return kept.drop("uncited"), rejected, stats


def deliver_top(accounts: DataFrame, kept: DataFrame | None, target: int | None) -> DataFrame:
    """A top-n search: judged accounts in the judge's order, or without a judge the first passed ones."""
    if kept is not None:
        return accounts.join(kept.select("account_id", "place", "fit", "fit_score"), "account_id")
    rows = accounts.filter("passed")
    if not target:
        return numbered(rows, [F.col("rank").asc()], "place")
    return rows.orderBy("rank").limit(target).withColumn("place", F.row_number().over(Window.orderBy("rank")))  # `target` rows


def deliver_map(accounts: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """A market map: passed accounts that weren't rejected, judged ones first by fit, others in rank order."""
    rows = accounts.filter("passed").join(rejected.select("account_id"), "account_id", "left_anti").join(kept.select("account_id", "fit", "fit_score"), "account_id", "left")
    return numbered(rows, [F.col("fit").isNull().asc(), F.desc("fit_score"), F.col("rank").asc()], "place")


def batches(queue: DataFrame, size: int = 20) -> DataFrame:
    """part and parts of a ranked queue."""
    return queue.withColumns({"part": (F.floor((F.col("rank") - 1) / size) + 1).cast("int"), "parts": F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / size).cast("int")})
