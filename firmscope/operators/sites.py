"""Websites of records: looked up by name, and read from staged pages within a budget.

Pages and scripts are tables of what a collector saved (url, html or body, error). What is
looked up in them is bounded by a search's budget of sites, pages and scripts, so that side is
broadcast and the tables are scanned once where they lie, never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..functions.region import Region, region_status
from ..sources.records import EVIDENCE, SITE, evidence

#: Characters of one page and of all pages of a site that are kept.
PAGE_TEXT, SITE_TEXT = 2500, 6000
#: Search results that are looked at for a website.
HITS = 5


def find_websites(records: DataFrame, hits: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Records with a website filled in where they have none.

    hits: record_id, pos (from 0), url, title. Of a record's first HITS results the first counts whose host (without
    hyphens) or title contains a telling word of the name; directories are passed over. A wrong site is worse than none.
    """
    bare = records.filter(F.coalesce("website", F.lit("")) == "").select("record_id", T.distinctive_tokens("name").alias("tokens"))
    # the host is worked out once a hit, though the list of directories names it many times; the hits are dealt anew, for they may lie in few files
    own = lambda d: F.when(d.isNotNull() & ~W.is_skipped(d, skip), d)
    top = hits.filter(F.col("pos") < HITS).repartition("record_id").withColumn("domain", F.explode(F.filter(F.transform(F.array(W.domain_of("url")), own), lambda d: d.isNotNull())))
    blob = F.concat(F.replace("domain", F.lit("-"), F.lit("")), F.lit(" "), F.lower(F.coalesce("title", F.lit(""))))
    met = top.join(bare, "record_id").filter(F.exists("tokens", lambda t: F.contains(blob, t)))
    found = met.groupBy("record_id").agg(F.min_by(F.concat(F.lit("https://"), "domain", F.lit("/")), "pos").alias("found"))
    rows = records.join(found, "record_id", "left")
    seen = F.array(evidence("website_lookup", F.lit("Website matched by name search"), F.col("found"))).cast(EVIDENCE)
    return rows.withColumns(
        {"website": F.coalesce("found", "website"), "evidence": F.when(F.col("found").isNotNull(), F.concat("evidence", seen)).otherwise(F.col("evidence"))}
    ).drop("found")


def address_key(url: Column) -> Column:
    """What two spellings of a page's address share: no scheme, www., fragment or closing slash."""
    plain = F.regexp_replace(F.split_part(F.lower(F.trim(url)), F.lit("#"), F.lit(1)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^www\.", ""), "/+$", "")


def budgeted(records: DataFrame, region: Region, most: int, order: str = "record_id") -> DataFrame:
    """domain, website of the first `most` distinct domains in record order.

    Records whose own address or place lies outside the region spend nothing of the budget.
    """
    ad = lambda c: F.col(f"address.{c}")
    own = region_status(region, ad("country"), ad("region"), ad("postal_code"), ad("city"), F.col("coords.lat"), F.col("coords.lon"), F.lit(""))
    rows = records.withColumns({"_domain": W.domain_of("website"), "_own": own}).filter(F.col("_domain").isNotNull() & (F.col("_own") != "out"))
    one = rows.groupBy(F.col("_domain").alias("domain")).agg(F.min(order).alias("at"), F.min_by("website", order).alias("website"))
    return one.orderBy("at", "domain").limit(most).select("domain", "website")


def read_sites(records: DataFrame, pages: DataFrame, region: Region | None = None, max_sites: int = 300, max_pages: int = 3, scripts: DataFrame | None = None, max_scripts: int = 0, order: str = "record_id") -> DataFrame:
    """Records with `site` (see SITE) from staged pages.

    pages: url, html, and optionally error. A site is its home page and the first `max_pages` - 1 useful links of it that
    are staged; a home page that isn't staged or failed gives a site with an error. Tools are read from the pages' embed
    code and from up to `max_scripts` of the site's own scripts (scripts: url, body). Records outside the region, without
    a website or beyond the budget of `max_sites` domains have a null site; records of one domain share it.
    """
    region = region or Region()
    error = F.col("error").cast("string") if "error" in pages.columns else F.lit(None).cast("string")
    staged = pages.select(address_key(F.col("url")).alias("key"), "url", "html", error.alias("error"))
    wanted = budgeted(records, region, max_sites, order)
    asked = wanted.select("domain", "website", address_key(F.col("website")).alias("key"))
    # a page staged twice counts once, as its least address
    home = staged.join(F.broadcast(asked), "key").groupBy("domain").agg(F.min_by(F.struct("url", "html", "error"), "url").alias("home"))
    home = asked.join(home, "domain", "left").select(
        "domain", F.coalesce("home.url", "website").alias("url"), F.col("home.html").alias("html"),
        F.when(F.col("home").isNull(), F.lit("page isn't staged")).when(F.coalesce("home.error", F.lit("")) != "", F.col("home.error")).when(F.col("home.html").isNull(), F.lit("no page")).alias("error"),
    )
    good = home.filter("error is null")
    links = good.select("domain", F.posexplode(F.slice(W.useful_links("html", "url"), 1, max(0, max_pages - 1))).alias("at", "link")).select("domain", "at", address_key(F.col("link")).alias("key"))
    more = staged.filter(F.coalesce("error", F.lit("")) == "").filter("html is not null").join(F.broadcast(links), "key")
    more = more.groupBy("domain", "at").agg(F.min_by(F.struct("url", "html"), "url").alias("p")).select("domain", (F.col("at") + 1).alias("at"), "p.url", "p.html")
    every = good.select("domain", F.lit(0).alias("at"), "url", "html").union(more)
    seen = every.select("domain", "at", "url", F.left(W.page_text("html"), F.lit(PAGE_TEXT)).alias("text"), W.detect("html").alias("tech"))
    per = seen.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("at", "url", "text", "tech"))).alias("p"))  # at most max_pages a site
    tech = F.flatten("p.tech")
    scanned = F.lit(0)
    if scripts is not None and max_scripts > 0:
        own = good.select("domain", F.explode(W.first_party_scripts("html", "url", max_scripts)).alias("s")).select("domain", address_key(F.col("s")).alias("key")).distinct()
        files = scripts.filter("body is not null").select(address_key(F.col("url")).alias("key"), W.detect_in_script("body").alias("tech")).join(F.broadcast(own), "key")
        files = files.dropDuplicates(["domain", "key"]).groupBy("domain").agg(F.flatten(F.collect_list("tech")).alias("more"), F.count(F.lit(1)).cast("int").alias("scanned"))
        per = per.join(files, "domain", "left")
        tech = F.concat(tech, F.coalesce("more", F.array().cast("array<string>")))
        scanned = F.coalesce("scanned", F.lit(0))
    per = per.select("domain", F.left(F.array_join("p.text", "\n\n"), F.lit(SITE_TEXT)).alias("text"), F.col("p.url").alias("pages"), F.array_sort(F.array_distinct(tech)).alias("tech"), scanned.alias("scripts_scanned"))
    ok = F.col("error").isNull()
    site = F.struct(
        "url", F.when(ok, W.page_title("html")).alias("title"), F.when(ok, W.page_description("html")).alias("description"), "text", "error",
        F.coalesce("pages", F.array().cast("array<string>")).alias("pages"), "tech", "scripts_scanned", F.when(ok, W.client_rendered("html")).alias("client_rendered"),
    )
    sites = home.join(per, "domain", "left").select(F.col("domain").alias("_domain"), site.cast(SITE).alias("site"))
    ad = lambda c: F.col(f"address.{c}")
    outside = region_status(region, ad("country"), ad("region"), ad("postal_code"), ad("city"), F.col("coords.lat"), F.col("coords.lon"), F.lit("")) == "out"
    rows = records.drop("site").withColumn("_domain", F.when(~outside, W.domain_of("website")))
    return rows.join(sites, "_domain", "left").drop("_domain")


def reading_counts(records: DataFrame) -> DataFrame:
    """One row: sites_read, sites_failed (distinct domains)."""
    d = F.when(F.col("site").isNotNull(), W.domain_of("website"))
    failed = F.when(F.coalesce("site.error", F.lit("")) != "", d)
    return records.agg(F.countDistinct(d).alias("sites_read"), F.countDistinct(failed).alias("sites_failed"))
