"""All searches in one plan give what each gives alone."""

import pytest
from pyspark.sql import functions as F

from firmscope.functions.region import Region
from firmscope.operators import accounts as A
from firmscope.operators import resolve, searches
from firmscope.sources.records import RECORD, SITE

DAY = "2025-01-20"
POLICIES = {
    "valves": A.Policy(region=Region(regions=["OR"], countries=["us"]), include_any=["valve"], exclude_any=["casino"], exclude_companies=["Old Customer, Inc."], registered_within_days=30, funded=True, hiring=True, prefer_small=True),
    "towns": A.Policy(region=Region(postal_prefixes=["97", "4"], cities=["Reno", "salem"]), region_strict=True, funded_within_days=10, min_signals=1, exclude_domains=["https://www.d3.example/x"], tech_absent=["chat"], tech_unverified_ok=True),
    "boxes": A.Policy(region=Region(bbox=(40.0, -125.0, 46.0, -115.0), site_terms=["Eugene", "St. Paul"]), require_website=True, site_patterns=["fam[a-z]+ owned", "since [0-9]+"], tech_present=["chat", "shop"], knockouts=["has_website", "in_region"]),
    "nothing": A.Policy(),
    "lands": A.Policy(region=Region(countries=["CA"]), include_any=["pump", "x{2,}"], tech_absent=["shop"], knockouts=["relevant"]),
}


def records():
    rows = []
    for i in range(60):
        seen = [(["registered", "funded", "hiring", "registry"][i % 4], [None, "d1", "d2"][i % 3], None, [None, "", "2025-01-15", "2024-01-01", "soon", "2025-02-01"][i % 6], "pump snippet" if i % 5 == 0 else None)] * (i % 3)
        name = ["Good Valve", "Casino Valve", "Old Customer LLC", "Pump House", "Xx Works"][i % 5] + f" {i // 5}" * (i % 5 != 2)
        place = (None, [None, "Salem", "Reno", "Paris"][i % 4], [None, "OR", "oregon", "NV"][i % 4], [None, "97401", "40001", "12345"][i // 4 % 4], [None, "US", "CA"][i % 3])
        rows.append((f"s:{i:02d}", "ab"[i % 2], name, None, f"https://d{i}.example" if i % 3 else None, place, None, ["valves"] if i % 2 else [], seen, (45.0, -120.0) if i % 7 == 0 else ((10.0, 10.0) if i % 7 == 1 else None), [None, 5, 50, 150, 500][i % 5]))
    return rows


@pytest.fixture(scope="module")
def accounts(spark):
    text = F.when(F.col("employees") == 50, "family owned since 1990 in Eugene.").when(F.col("employees") == 5, "St. Paulus").otherwise(F.lit(None))
    tech = F.when(F.col("employees") == 150, F.array(F.lit("tag_manager:g"))).when(F.col("employees") == 50, F.array(F.lit("chat:x"), F.lit("shop:y"))).when(F.col("employees") == 500, F.array().cast("array<string>"))
    site = F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("description"), text.alias("text"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("pages"), tech.alias("tech"), F.lit(0).alias("scripts_scanned"), (F.col("employees") == 5).alias("client_rendered"))
    rows = spark.createDataFrame(records(), RECORD).withColumn("site", F.when(F.col("employees").isNotNull(), site).cast(SITE))
    return resolve.accounts(rows).cache()


def shown(row):
    d = row.asDict(recursive=True)
    return {k: d[k] for k in ("region_status", "signals", "keyword_hits", "size_band", "filters", "tech_status", "seen_recent", "passed", "score", "rank")}


def test_one_plan_equals_single_runs(spark, accounts):
    policies = searches.policy_table(spark, POLICIES)
    late = spark.createDataFrame([("valves", "GOOD VALVE 1"), ("nothing", "Pump House 0"), ("nothing", "pump house 0")], "search string, name string")
    each = accounts.crossJoin(policies.select("search"))
    day = F.lit(DAY).cast("date")
    got = {(r.search, r.account_id): shown(r) for r in searches.ranked_all(searches.evaluated_all(each, policies, day, late)).collect()}
    passed = {}
    for name, policy in POLICIES.items():
        alone = A.ranked(A.evaluated(accounts, policy, day, late.filter(F.col("search") == name)))
        for r in alone.collect():
            assert got.pop((name, r.account_id)) == shown(r), (name, r.account_id)
            passed[name] = passed.get(name, 0) + r.passed
    assert not got and all(0 < passed[n] < accounts.count() for n in ("valves", "boxes", "lands"))


def test_funnels(spark, accounts):
    policies = searches.policy_table(spark, POLICIES)
    rows = searches.evaluated_all(accounts.withColumn("search", F.lit("valves")), policies, F.lit(DAY).cast("date"))
    one = searches.funnels(rows).collect()
    assert [r.search for r in one] == ["valves"] and one[0].accounts == accounts.count() and one[0].passed == rows.filter("passed").count() > 0
    assert searches.evaluated_all(accounts.withColumn("search", F.lit("unknown")), policies, F.lit(DAY).cast("date")).count() == 0
