"""Purchase queries, the keep rule and the export on small cases."""

import json

import pytest

from firmscope.operators import buyers as B
from firmscope.operators import purchases as P
from firmscope.sources.listings import award_rows

LISTED = [("sl", "Sloan Valve", 0), ("gv", "Valve Company", 1), ("ob", "O'Brien Pumps", 2)]
CITY = {"domain": "data.example.gov", "dataset": "abcd-1234", "fields": {"vendor": "vendor_name", "unit": "department", "description": "description", "amount": "award_amount", "date": "start_date", "id": "contract_number"}}


@pytest.fixture
def listed(spark):
    return spark.createDataFrame(LISTED, "account_id string, name string, pos long")


def answer(*awards, more=None, **other):
    names = {"k": "generated_internal_id", "v": "Recipient Name", "a": "Award Amount"}
    body = {"results": [{names[k]: v for k, v in a.items()} for a in awards]} | other
    return json.dumps(body if more is None else body | {"page_metadata": {"hasNext": more}})


def test_award_found_by_two_lookups_stays_with_its_company(spark, listed):
    """A stranger's lookup found it first; only the vendor's own may keep it, the market keeps all."""
    rows = [
        ("gv", 1, 1, answer({"k": "x", "v": "SLOAN VALVE CO", "a": 5.0})),
        ("sl", 2, 1, answer({"k": "x", "v": "SLOAN VALVE CO", "a": 5.0}, {"k": "y", "v": "SLOAN CONSULTING", "a": 1.0}, {"v": "SLOAN VALVE", "a": 7.0})),
        ("market", 0, 1, answer({"k": "z", "v": "CORE AND MAIN", "a": 2.0}, {"k": "z", "v": "CORE AND MAIN", "a": 2.0})),
    ]
    got = P.kept_awards(spark.createDataFrame(rows, "purpose string, qpos int, page int, payload string"), listed, 100).collect()
    assert {(r.key, r.purpose, r.vendor_account_id, r.amount, r.url) for r in got} == {
        ("x", "sl", "sl", 5.0, "https://www.usaspending.gov/award/x"), (None, "sl", "sl", 7.0, ""), ("z", "market", None, 2.0, "https://www.usaspending.gov/award/z"),
    }
    assert {r.buyer for r in got} == {"Unknown federal agency"}


def test_pages_end_and_errors_are_raised(spark):
    schema = "purpose string, qpos int, page int, payload string"
    one = lambda k: {"k": k, "v": "V", "a": 1.0}
    rows = [("market", 0, 1, answer(one("a"), one("b"), more=True)), ("market", 0, 2, answer(one("c"), more=False)), ("market", 0, 3, answer(one("late"))), ("q", 1, 1, answer(more=True)), ("q", 1, 2, answer(one("after none")))]
    assert sorted(r.key for r in award_rows(spark.createDataFrame(rows, schema), 100).collect()) == ["a", "b", "c"]
    assert sorted(r.key for r in award_rows(spark.createDataFrame(rows, schema), 2).collect()) == ["a", "b"]
    bad = spark.createDataFrame([("market", 0, 1, answer(detail="too many requests"))], schema)
    with pytest.raises(Exception, match="too many requests"):
        award_rows(bad, 100).collect()


def test_queries(spark, listed):
    got = [(r.qpos, r.purpose, json.loads(r.body)["filters"]) for r in P.award_queries(listed, "2025-01-31", 1, naics=[332911]).collect()]
    times = {"award_type_codes": ["A", "B", "C", "D"], "time_period": [{"start_date": "2024-02-01", "end_date": "2025-01-31"}]}
    assert got == [(0, "market", times | {"naics_codes": {"require": ["332911"]}}), (1, "sl", times | {"recipient_search_text": ["SLOAN"]}), (3, "ob", times | {"recipient_search_text": [got[2][2]["recipient_search_text"][0]]})]
    assert P.award_queries(listed, "2025-01-31", by_company=False).count() == 0


def test_city(spark, listed):
    row = P.city_query(listed, CITY, ["valve') OR 1=1 --", "(("], "2021-09-18").first()
    assert row.url == "https://data.example.gov/resource/abcd-1234.json" and row.order == "start_date DESC" and row.limit == 1000
    assert "upper(description) like '%VALVE'' OR 11 --%'" in row["where"] and "upper(vendor_name) like '%SLOAN%'" in row["where"] and row["where"].endswith(" AND start_date >= '2021-09-18T00:00:00'")
    with pytest.raises(P.PurchaseError) as e:
        P.checked_city({"domain": "data.example.gov/../x", "dataset": "abcd-1234.json?x", "fields": {**CITY["fields"], "vendor": "vendor_name) OR (1"}})
    assert all(n in str(e.value) for n in ("domain", "dataset", "fields.vendor"))
    with pytest.raises(Exception, match="keywords or companies"):
        P.city_query(listed.filter("false"), CITY, [], "2021-09-18").collect()
    rows = spark.createDataFrame([("SLOAN VALVE CO", "WATER", "x" * 400, "12.5", "2025-03-01T00:00"), ("", "a", "b", "1", ""), ("CORE", None, None, "not a number", None)], "vendor_name string, department string, description string, award_amount string, start_date string")
    got = P.city_rows(rows, CITY).collect()
    assert [(r.vendor, r.buyer, r.amount, r.date, len(r.description), r.award_id) for r in got] == [("SLOAN VALVE CO", "data.example.gov", 12.5, "2025-03-01", 300, ""), ("CORE", "data.example.gov", 0.0, "", 0, "")]


def test_export_columns(spark):
    rows = spark.createDataFrame([("b", 1.0, "m"), ("a", 9.0, "m")], "vendor string, amount double, purpose string")
    got = P.purchase_export(rows)
    assert got.columns == P.PURCHASE_COLUMNS and [r.vendor for r in got.collect()] == ["a", "b"]


def test_long_lists_of_domains(spark):
    from firmscope.operators import domains as D

    rows = spark.createDataFrame([(1, "a.b.org"), (2, "b.org"), (3, "ab.org"), (4, None), (5, "c.net"), (6, "x.c.net"), (6, "x.c.net")], "k int, domain string")
    listed = spark.createDataFrame([("https://www.B.org/x",), ("x.c.net",), (None,), ("net.c",)], "domain string")
    assert sorted(r.k for r in D.without_listed(rows, listed).collect()) == [3, 4, 5]
    assert {(r.domain, r.entry) for r in D.listed_among(rows, listed).collect()} == {("a.b.org", "b.org"), ("b.org", "b.org"), ("x.c.net", "x.c.net")}
    assert D.without_listed(rows, listed.limit(0)).count() == 7


def test_every_vendor_of_a_buyer_is_listed(spark):
    rows = [("A", None if n % 3 else f"L{n:02}", f"v{n:02}", 2.0) for n in range(40) for _ in range(2)] + [("B", None, None, 1.0)]
    df = spark.createDataFrame(rows, "label string, listed_company string, vendor string, amount double")
    got = {r["label"]: (float(r["total"]), r["count"], r["vendors"]) for r in B.top_buyers(df).collect()}
    assert got == {"A": (160.0, 80, sorted(f"v{n:02}" if n % 3 else f"L{n:02}" for n in range(40))), "B": (1.0, 1, [])}


def test_every_buyer_of_an_unlisted_vendor_is_listed(spark):
    rows = [(f"L{n:02}", None, "v", 2.0) for n in range(30)] + [("L99", "listed", "v", 2.0), ("L1", None, None, 1.0)]
    df = spark.createDataFrame(rows, "label string, vendor_account_id string, vendor string, amount double")
    got = {r["vendor"]: (float(r["total"]), r["count"], r["buyers"]) for r in B.other_vendors(df).collect()}
    assert got == {"v": (60.0, 30, [f"L{n:02}" for n in range(30)]), None: (1.0, 1, ["L1"])}


def test_pages_of_many_blocks_are_counted_on_and_end_once(spark):
    """300 pages of two awards each; the second query's end with page 200, and a block's order goes on from the blocks before it."""
    rows = [(q, n, answer({"k": f"{q}-{n}a"}, {"k": f"{q}-{n}b"}, more=(q, n) != (2, 200))) for q in (1, 2) for n in range(1, 301)]
    pages = spark.createDataFrame(rows, "qpos int, page int, payload string").selectExpr("'market' as purpose", "*").repartition(7)
    found = {(r.qpos, r.nth): r.key for r in award_rows(pages, 500).collect()}
    assert found == {(q, 2 * n - 1 + k): f"{q}-{n}{'ab'[k]}" for q, last in ((1, 250), (2, 200)) for n in range(1, last + 1) for k in (0, 1)}


def test_no_task_orders_all_answers_of_a_query(spark):
    pages = spark.createDataFrame([("market", 0, 1, answer({"k": "x"}))], "purpose string, qpos int, page int, payload string")
    plan = award_rows(pages, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert not [w for w in plan.splitlines() if "Window" in w and "[qpos" in w]


def test_generic_companies_meet_only_vendors_of_just_their_words(spark):
    """Companies of the same generic words count once, and their join doesn't bring every vendor with such a word together with them."""
    companies = spark.createDataFrame([(f"c{n}", "Valve Company", n) for n in range(300)] + [("s", "Sloan Valve", 300), ("t", "Valve Sloan Inc", 299)], "account_id string, name string, pos long")
    vendors = spark.createDataFrame([(f"MAKER{n} VALVES",) for n in range(300)] + [("VALVES LLC",), ("SLOAN VALVE WORKS",)], "vendor string")
    matched = B.match_vendors(vendors, companies)
    assert sorted(map(tuple, matched.collect())) == [("SLOAN VALVE WORKS", "t"), ("VALVES LLC", "c0")]


def test_pages_of_award_lookups_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from firmscope.plans import buying

    spark.range(20_000).selectExpr("id as o_orderkey", "id % 700 as o_custkey", "'O' as o_orderstatus", "300000D as o_totalprice", "'1' as o_orderpriority", "timestamp'2024-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    seen, kept = [], P.kept_awards
    monkeypatch.setattr(P, "kept_awards", lambda pages, *rest: seen.append(pages) or kept(pages, *rest))
    assert buying.award_lookups(spark, str(tmp_path)).count() == 20_000
    assert seen[0].selectExpr("max(length(payload))").first()[0] < 60_000
