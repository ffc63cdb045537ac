"""Signals, filters, score and rank of accounts: every filter is a visible column, no row is dropped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..functions.region import Region, region_status
from .ordering import numbered

SIGNALS = "array<struct<kind:string,detail:string,url:string>>"
FILTERS = ["in_region", "relevant", "no_exclude_terms", "not_excluded", "signal_ok", "has_website", "tech_ok"]


@dataclass(frozen=True)
class Policy:
    """What one search asks of an account."""

    region: Region = field(default_factory=Region)
    region_strict: bool = False
    include_any: list[str] = field(default_factory=list)
    exclude_any: list[str] = field(default_factory=list)
    exclude_companies: list[str] = field(default_factory=list)
    exclude_domains: list[str] = field(default_factory=list)
    min_signals: int = 0
    require_website: bool = False
    tech_absent: list[str] = field(default_factory=list)
    tech_present: list[str] = field(default_factory=list)
    tech_unverified_ok: bool = False
    registered_within_days: int | None = None
    site_patterns: list[str] = field(default_factory=list)
    funded: bool = False
    funded_within_days: int | None = None
    hiring: bool = False
    prefer_small: bool = False
    knockouts: list[str] = field(default_factory=lambda: list(FILTERS))


def iso_day(text: Column) -> Column:
    """The day in the first ten characters, or null."""
    return F.when(F.left(text, F.lit(10)).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.left(text, F.lit(10)).try_cast("date"))


def distinct_by_detail(signals: Column) -> Column:
    """The first signal of each detail."""
    def add(a: Column, s: Column) -> Column:
        return F.when(F.exists(a, lambda x: x["detail"] == s["detail"]), a).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(signals, F.array().cast(SIGNALS), add)


def signals_for(policy: Policy, run_day: Column, evidence: Column, site: Column | None = None) -> Column:
    """Recent registration, phrases on the site, funding, hiring, in that order; equal details once."""
    signal = lambda kind, detail, url: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.coalesce(url, F.lit("")).alias("url"))
    none, parts = F.array().cast(SIGNALS), []
    if policy.registered_within_days:
        def recent(e: Column) -> Column:
            age = F.datediff(run_day, iso_day(e["date"]))
            text = F.concat(F.lit("Registered "), F.left(e["date"], F.lit(10)), F.lit(" ("), age.cast("string"), F.lit(" days ago)"))
            return F.when((e["kind"] == "registered") & age.between(0, policy.registered_within_days), signal("recently_registered", text, e["url"]))

        parts.append(F.array_compact(F.transform(evidence, recent)))
    if site is not None:
        for p in policy.site_patterns:
            hit = F.regexp_extract(F.coalesce(site["text"], F.lit("")), f"(?iu)({p})", 1)
            parts.append(F.when(hit != "", F.array(signal("site_mention", F.concat(F.lit('Site says "'), hit, F.lit('"')), site["url"]))).otherwise(none))
    if policy.funded or policy.funded_within_days:
        def funded(e: Column) -> Column:
            fresh = F.lit(True)
            if policy.funded_within_days:  # undated evidence passes, malformed dates don't, later ones do
                fresh = (F.coalesce(e["date"], F.lit("")) == "") | F.coalesce(F.datediff(run_day, iso_day(e["date"])) <= policy.funded_within_days, F.lit(False))
            return F.when((e["kind"] == "funded") & fresh, signal("funded", F.coalesce(e["detail"], F.lit("Recently funded")), e["url"]))

        parts.append(F.array_compact(F.transform(evidence, funded)))
    if policy.hiring:
        parts.append(F.array_compact(F.transform(evidence, lambda e: F.when(e["kind"] == "hiring", signal("hiring", F.coalesce(e["detail"], F.lit("Open posting")), e["url"])))))
    return distinct_by_detail(F.concat(*[p.cast(SIGNALS) for p in parts])) if parts else none


def relevance_text() -> Column:
    snippets = F.array_join(F.transform("evidence", lambda e: e["snippet"]), "\n")
    return F.concat_ws("\n", "name", F.array_join("categories", " "), "site.title", "site.description", "site.text", snippets)


def size_band(employees: Column, site_text: Column) -> Column:
    small = F.coalesce(site_text, F.lit("")).rlike("(?i)family[- ]owned|family[- ]run|owner[- ]operated")
    return F.when(employees < 20, "under 20").when(employees < 100, "20-99").when(employees < 250, "100-249").when(employees.isNotNull(), "250+").when(small, "small (site)").otherwise("unknown")


def evaluated(accounts: DataFrame, policy: Policy, run_day: Column, recent: DataFrame | None = None) -> DataFrame:
    """Add region_status, signals, keyword_hits, size_band, filters, tech_status, seen_recent, passed and score.

    recent: names surfaced lately (column name); a match suppresses an account.
    """
    names = [n for n in policy.exclude_companies]
    a = accounts.withColumn("_text", relevance_text())
    ad = lambda c: F.col(f"address.{c}")
    status = region_status(policy.region, ad("country"), ad("region"), ad("postal_code"), ad("city"), F.col("coords.lat"), F.col("coords.lon"), F.col("_text"))
    a = a.withColumns({
        "region_status": status, "signals": signals_for(policy, run_day, F.col("evidence"), F.col("site")),
        "keyword_hits": T.pattern_hits("_text", policy.include_any), "size_band": size_band(F.col("employees"), F.col("site.text")),
    })
    listed = F.lit(False)
    for n in names:
        listed = listed | (T.normalize_name("name") == T.normalize_name(F.lit(n)))
    for d in policy.exclude_domains:
        listed = listed | F.coalesce(F.col("domain") == W.domain_of(F.lit(d)), F.lit(False))
    filters = {
        "in_region": (F.col("region_status") == "in") | (F.lit(not policy.region_strict) & (F.col("region_status") == "unknown")),
        "relevant": F.lit(not policy.include_any) | (F.size("keyword_hits") > 0),
        "no_exclude_terms": F.size(T.pattern_hits("_text", policy.exclude_any)) == 0,
        "not_excluded": ~listed,
        "signal_ok": F.size("signals") >= policy.min_signals,
        "has_website": F.lit(not policy.require_website) | (F.coalesce("website", F.lit("")) != ""),
        "tech_ok": W.tools_ok("site", policy.tech_absent, policy.tech_present, policy.tech_unverified_ok),
    }
    a = a.withColumn("filters", F.struct(*[v.alias(k) for k, v in filters.items()]))
    categories = list(dict.fromkeys([*policy.tech_absent, *policy.tech_present]))
    pairs = [x for c in categories for x in (F.lit(c), W.tool_status("site", c))]
    a = a.withColumn("tech_status", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
    seen = F.lit(False)
    if recent is not None:
        hits = a.select("name").distinct().join(recent.select(F.lower("name").alias("n")).distinct(), F.lower("name") == F.col("n"), "left_semi").withColumnRenamed("name", "seen_name")
        a = a.join(hits, F.col("name") == F.col("seen_name"), "left")
        seen = F.col("seen_name").isNotNull()
    a = a.withColumn("seen_recent", seen)
    asked = [*policy.knockouts, *(["tech_ok"] if categories and "tech_ok" not in policy.knockouts else [])]
    passed = ~F.col("seen_recent")
    for k in asked:
        passed = passed & (F.col(f"filters.{k}") if k in filters else F.lit(False))
    bonus = F.create_map(*[F.lit(x) for x in ("under 20", 4, "20-99", 3, "small (site)", 2, "100-249", 1)])
    score = (
        3 * F.size("signals") + F.least(F.size("keyword_hits"), F.lit(5)) + F.when(F.coalesce("site.text", F.lit("")) != "", 2).otherwise(0)
        + (F.size("sources") > 1).cast("int") + (F.col("region_status") == "in").cast("int")
    )
    if policy.prefer_small:
        score = score + F.coalesce(F.try_element_at(bonus, F.col("size_band")), F.lit(0))
    return a.withColumns({"passed": passed, "score": score}).drop("_text", "seen_name")


def rank_order() -> list[Column]:
    """Passed first, then score, then lower-case name; account_id settles ties."""
    return [F.desc("passed"), F.desc("score"), F.lower("name").asc(), F.col("account_id").asc()]


def ranked(accounts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rank from 1 in rank order, numbered by ranges. by: one ranking each (a search)."""
    return numbered(accounts, rank_order(), "rank", by)


def judge_queue(accounts: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The first passed accounts in rank order; each task keeps its first `most` before they meet."""
    passed = accounts.filter("passed")
    if not by:
        passed = passed.orderBy(*rank_order()).limit(most)
    first = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*rank_order())
    return passed.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)


def bounded_view(accounts: DataFrame, text: int = 3000, evidence: int = 10) -> DataFrame:
    """What a judge may see of an account: site text and evidence cut after scoring."""
    return accounts.withColumn("site", F.when(F.col("site").isNotNull(), F.col("site").withField("text", F.left("site.text", F.lit(text))))).withColumn("evidence", F.slice("evidence", 1, evidence))
