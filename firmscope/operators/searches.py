"""All searches in one plan: their policies are a table, joined to accounts by search.

`accounts.evaluated` writes one policy's rules into a plan. Here the rules are data: regular expressions, places, tools and
thresholds are columns of a policy table (one row a search, so small), and one pass over all searches' accounts
evaluates, numbers and counts them, however many searches there are.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from . import accounts as A
from .ordering import numbered

_TEXTS = "array<string>"
POLICY = f"""search string, codes {_TEXTS}, countries {_TEXTS}, postal_prefixes {_TEXTS}, cities {_TEXTS}, bbox array<double>, site_terms {_TEXTS}, region_strict boolean,
  include_any {_TEXTS}, exclude_any {_TEXTS}, exclude_companies {_TEXTS}, exclude_domains {_TEXTS}, min_signals int, require_website boolean, tech_absent {_TEXTS}, tech_present {_TEXTS},
  tech_unverified_ok boolean, registered_within_days int, site_patterns {_TEXTS}, funded boolean, funded_within_days int, hiring boolean, prefer_small boolean, knockouts {_TEXTS}"""


def policy_table(spark: SparkSession, policies: dict[str, A.Policy]) -> DataFrame:
    """One row a search: search and p, its rules. Excluded names and domains are brought to the form that accounts are compared in."""
    rows = []
    for name, policy in policies.items():
        own = asdict(policy)
        region = own.pop("region")
        own |= {k: [str(x) for x in region[k]] for k in ("countries", "postal_prefixes", "cities")}
        own["site_terms"] = [f"(?<![A-Za-z]){re.escape(t)}(?![A-Za-z])" for t in region["site_terms"]]
        rows.append(json.dumps(own | {"search": name, "codes": policy.region.codes(), "bbox": list(region["bbox"] or [])}))
    p = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", f"struct<{re.sub(r'(\w+) (array|string|boolean|int)', r'\1:\2', POLICY)}>").alias("p"))
    small = lambda field: F.transform(F.col(f"p.{field}"), F.lower)
    named = F.col("p").withField("exclude_companies", F.transform("p.exclude_companies", T.normalize_name)).withField("exclude_domains", F.transform("p.exclude_domains", W.domain_of))
    named = named.withField("cities", small("cities")).withField("countries", F.transform("p.countries", F.upper))
    return p.select(F.col("p.search").alias("search"), named.alias("p"))


def _any(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _matching(text: Column, patterns: Column) -> Column:
    return F.filter(patterns, lambda p: F.rlike(text, F.concat(F.lit("(?iu)"), p)))


def place_status(p: Column, country: Column, state: Column, postal: Column, city: Column, lat: Column, lon: Column, text: Column) -> Column:
    """region_status with the region as data: what the address says, then the position, then the text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    has = lambda k: F.size(p[k]) > 0
    c, code, zip_code, town = F.upper(blank(country)), F.coalesce(T.region_code(blank(state)), F.lit("")), F.trim(blank(postal)), F.lower(blank(city))
    yes = lambda test: F.when(test, "in").otherwise("out")
    inside = lat.between(F.get(p["bbox"], F.lit(0)), F.get(p["bbox"], F.lit(2))) & lon.between(F.get(p["bbox"], F.lit(1)), F.get(p["bbox"], F.lit(3)))
    return (
        F.when(has("countries") & (c != "") & ~F.array_contains(p["countries"], c), "out")
        .when(has("codes") & (code != "") & ~F.array_contains(p["codes"], code), "out")
        .when(has("postal_prefixes") & (zip_code != ""), yes(_any(p["postal_prefixes"], lambda x: F.startswith(zip_code, x))))
        .when(has("postal_prefixes") & has("cities") & (town != ""), yes(F.array_contains(p["cities"], town)))
        .when(~has("postal_prefixes") & has("codes") & (code != ""), "in")
        .when(has("bbox") & lat.isNotNull(), yes(inside))
        .when(~has("codes") & has("countries") & (c != ""), "in")
        .when(_any(p["site_terms"], lambda t: F.rlike(blank(text), t)), "in")
        .otherwise("unknown")
    )


def signals(p: Column, run_day: Column, evidence: Column, site: Column) -> Column:
    """The signals that the policy asks for, in the order registration, phrases, funding, hiring; equal details once."""
    def signal(kind: str, detail: Column, url: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.coalesce(url, F.lit("")).alias("url"))

    age = lambda e: F.datediff(run_day, A.iso_day(e["date"]))
    registered = F.filter(evidence, lambda e: (e["kind"] == "registered") & (F.coalesce(p["registered_within_days"], F.lit(0)) > 0) & age(e).between(0, p["registered_within_days"]))
    registered = F.transform(registered, lambda e: signal("recently_registered", F.concat(F.lit("Registered "), F.left(e["date"], F.lit(10)), F.lit(" ("), age(e).cast("string"), F.lit(" days ago)")), e["url"]))
    said = F.transform(p["site_patterns"], lambda x: F.call_function("regexp_extract", F.coalesce(site["text"], F.lit("")), F.concat(F.lit("(?iu)("), x, F.lit(")")), F.lit(1)))
    said = F.transform(F.filter(said, lambda hit: hit != ""), lambda hit: signal("site_mention", F.concat(F.lit('Site says "'), hit, F.lit('"')), site["url"]))
    within = F.coalesce(p["funded_within_days"], F.lit(0))
    fresh = lambda e: (within == 0) | (F.coalesce(e["date"], F.lit("")) == "") | F.coalesce(age(e) <= within, F.lit(False))
    funded = F.transform(F.filter(evidence, lambda e: (p["funded"] | (within > 0)) & (e["kind"] == "funded") & fresh(e)), lambda e: signal("funded", F.coalesce(e["detail"], F.lit("Recently funded")), e["url"]))
    hiring = F.transform(F.filter(evidence, lambda e: p["hiring"] & (e["kind"] == "hiring")), lambda e: signal("hiring", F.coalesce(e["detail"], F.lit("Open posting")), e["url"]))
    return A.distinct_by_detail(F.concat(*[x.cast(A.SIGNALS) for x in (registered, said, funded, hiring)]))


def evaluated_all(accounts: DataFrame, policies: DataFrame, run_day: Column, recent: DataFrame | None = None) -> DataFrame:
    """accounts: search and the columns of accounts; policies: of `policy_table`; recent: search, name (surfaced lately).

    Adds what `accounts.evaluated` adds, each account by its own search's rules. Accounts of a search without a policy go.
    """
    a = accounts.join(policies, "search").withColumn("_text", A.relevance_text())  # Spark broadcasts the policies while they are small
    p, ad = F.col("p"), lambda c: F.col(f"address.{c}")
    a = a.withColumns({
        "region_status": place_status(p, ad("country"), ad("region"), ad("postal_code"), ad("city"), F.col("coords.lat"), F.col("coords.lon"), F.col("_text")),
        "signals": signals(p, run_day, F.col("evidence"), F.col("site")), "keyword_hits": _matching(F.col("_text"), p["include_any"]), "size_band": A.size_band(F.col("employees"), F.col("site.text")),
    })
    asked = F.array_distinct(F.concat(p["tech_absent"], p["tech_present"]))
    a = a.withColumn("tech_status", F.map_from_entries(F.transform(asked, lambda c: F.struct(c, W.tool_status("site", c)))))
    status = lambda c: F.try_element_at("tech_status", c)
    missing = lambda c: (status(c) == "absent") | (p["tech_unverified_ok"] & (status(c) == "absent_unverified"))
    listed = F.array_contains(p["exclude_companies"], T.normalize_name("name")) | F.coalesce(F.array_contains(p["exclude_domains"], F.col("domain")), F.lit(False))
    filters = {
        "in_region": (F.col("region_status") == "in") | (~p["region_strict"] & (F.col("region_status") == "unknown")),
        "relevant": (F.size(p["include_any"]) == 0) | (F.size("keyword_hits") > 0),
        "no_exclude_terms": F.size(_matching(F.col("_text"), p["exclude_any"])) == 0,
        "not_excluded": ~listed,
        "signal_ok": F.size("signals") >= p["min_signals"],
        "has_website": ~p["require_website"] | (F.coalesce("website", F.lit("")) != ""),
        "tech_ok": F.forall(p["tech_absent"], missing) & F.forall(p["tech_present"], lambda c: status(c) == "present"),
    }
    a = a.withColumn("filters", F.struct(*[v.alias(k) for k, v in filters.items()]))
    seen = F.lit(False)
    if recent is not None:
        late = recent.select(F.col("search").alias("_s"), F.lower("name").alias("_n")).distinct()
        a = a.join(late, (F.col("search") == F.col("_s")) & (F.lower("name") == F.col("_n")), "left")
        seen = F.col("_n").isNotNull()
    needed = F.array_union(p["knockouts"], F.when(F.size(asked) > 0, F.array(F.lit("tech_ok"))).otherwise(F.array().cast(_TEXTS)))
    met = F.create_map(*[x for k in filters for x in (F.lit(k), F.col(f"filters.{k}"))])
    a = a.withColumn("seen_recent", seen).withColumn("passed", ~F.col("seen_recent") & F.forall(needed, lambda k: F.coalesce(F.try_element_at(met, k), F.lit(False))))
    bonus = F.create_map(*[F.lit(x) for x in ("under 20", 4, "20-99", 3, "small (site)", 2, "100-249", 1)])
    score = (
        3 * F.size("signals") + F.least(F.size("keyword_hits"), F.lit(5)) + F.when(F.coalesce("site.text", F.lit("")) != "", 2).otherwise(0)
        + (F.size("sources") > 1).cast("int") + (F.col("region_status") == "in").cast("int") + F.when(p["prefer_small"], F.coalesce(F.try_element_at(bonus, F.col("size_band")), F.lit(0))).otherwise(0)
    )
    return a.withColumn("score", score).drop("_text", "_s", "_n", "p")


def ranked_all(accounts: DataFrame) -> DataFrame:
    """Evaluated accounts with their rank in their search."""
    return numbered(accounts, A.rank_order(), "rank", ["search"])


def funnels(ranked: DataFrame) -> DataFrame:
    """One row a search: accounts, those that each filter lets through, those that passed, and the best score."""
    passed = [F.count_if(F.col(f"filters.{k}")).alias(k) for k in A.FILTERS]
    return ranked.groupBy("search").agg(F.count(F.lit(1)).alias("accounts"), *passed, F.count_if("passed").alias("passed"), F.max("score").alias("best"))
