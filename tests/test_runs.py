"""A whole run from records to files, twice: a second date suppresses what the first surfaced."""

import json

import pytest

from firmscope import __main__ as cli
from firmscope.plans import runs

RECORDS = [
    {"record_id": f"a:{i}", "source": "a", "name": f"Valve Works {i}, Inc.", "website": f"https://v{i}.example", "address": {"city": "Salem", "region": "OR", "country": "US"}, "categories": ["valves"], "evidence": [], "employees": 10 * i}
    for i in range(4)
]
PROFILE = {"searches": {"pumps": {"goal": "top_n", "target_count": 2, "region": {"regions": ["OR"]}, "include_any": ["valve"], "sources": [{"type": "csv"}], "judge": {"drafts": True}}}, "context": ["Pumps"]}
DECISION = {"pos": 1, "account_id": "v1-example", "decision": "keep", "fit": "strong", "fit_score": 4, "what_they_do": "x", "why_fit": [{"text": "t", "context_id": "Pumps"}], "signals": [{"detail": "d", "url": "u"}], "risks": ["r"], "draft": {"channel": "email", "subject": "s", "body": "b"}}


def test_run(spark, tmp_path):
    (tmp_path / "records" / "pumps").mkdir(parents=True)
    (tmp_path / "records" / "pumps" / "a.json").write_text("\n".join(map(json.dumps, RECORDS)))
    (tmp_path / "profile.json").write_text(json.dumps(PROFILE))
    (tmp_path / "decisions.json").write_text(json.dumps(DECISION))
    (tmp_path / "buys" / "pumps").mkdir(parents=True)
    (tmp_path / "buys" / "pumps" / "p.json").write_text(json.dumps({"buyer": "City", "buyer_unit": "Water", "vendor": "VALVE WORKS 1 CO", "amount": 1500.0}))
    base = ["--profile", str(tmp_path / "profile.json"), "--records", str(tmp_path / "records"), "--root", str(tmp_path / "out")]
    assert cli.main([*base, "--date", "2025-01-01", "--decisions", str(tmp_path / "decisions.json"), "--purchases", str(tmp_path / "buys")]) == 0
    text = (tmp_path / "out" / "reports" / "2025-01-01.md").read_text()
    assert "4 records → 4 companies → 4 passed filters → 1 kept → 3 rejected." in text and "Valve Works 1, Inc. (strong, 4 of 5)" in text and "City / Water: $1,500 over 1 purchases, to Valve Works 1, Inc." in text and "Listed companies with purchases: 1 of 1." in text
    names = {p.name for p in (tmp_path / "out" / "pumps" / "exports" / "2025-01-01").iterdir()}
    assert names == {"accounts", "queue", "purchases"}
    assert cli.main([*base, "--date", "2025-01-02"]) == 0
    text = (tmp_path / "out" / "reports" / "2025-01-02.md").read_text()
    assert "3 passed filters" in text and "Valve Works 1, Inc." not in text
    assert [x[:12] for x in (tmp_path / "out" / "index.md").read_text().splitlines()[-2:]] == ["| 2025-01-01", "| 2025-01-02"]
    (tmp_path / "decisions.json").write_text('{"pos": 1, "account_id": "x", "decision": "maybe"}')
    assert cli.main([*base, "--date", "2025-01-03", "--decisions", str(tmp_path / "decisions.json")]) == 2
    (tmp_path / "decisions.json").write_text('{"pos": "x"')
    assert cli.main([*base, "--date", "2025-01-03", "--decisions", str(tmp_path / "decisions.json")]) == 4
    assert cli.main(["judge", *base, "--date", "2025-01-03", "--dry-run"]) == 0
    assert cli.main(["--profile", "none.json", *base[2:], "--date", "2025-01-02"]) == 1


def test_a_failing_source_is_logged(spark):
    def broken():
        raise OSError("no file")

    rows, log = runs.discovered({"good": lambda: spark.range(3), "bad": broken})
    assert rows.count() == 3 and log == [("good", "ok", 3, ""), ("bad", "failed", 0, "no file")]


PAGES = [
    {"url": "https://www.v1.example/", "html": "<title>Valves &#8211; &#x41;1</title><a href='about/../about-us'>x</a><script src='/app.js'></script>we make valves"},
    {"url": "https://v1.example/about-us", "html": "<script src='https://assets.calendly.com/a.js'></script>family owned"},
    {"url": "https://v2.example", "html": None, "error": "timeout"},
    {"url": "https://v9.example", "html": "other"},
]


def test_discover_enrich_and_run(spark, tmp_path):
    """A list as source, one that fails, sites under a budget of three, tools from a page and a script."""
    (tmp_path / "list.csv").write_text("Name,Website,City,State,Region,Country\n" + "\n".join(f"Valve Works {i},https://v{i}.example,Salem,,{'OR' if i else 'TX'},US" for i in range(5)) + "\n")
    search = {"goal": "market_map", "region": {"regions": ["OR"]}, "tech_absent": ["chat"], "enrich": {"max_sites": 3, "max_scripts": 2}, "sources": [{"type": "csv", "path": str(tmp_path / "list.csv")}, {"type": "npi", "path": str(tmp_path / "none")}]}
    (tmp_path / "p.json").write_text(json.dumps({"searches": {"valves": search}}))
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, PAGES)))
    (tmp_path / "scripts.json").write_text(json.dumps({"url": "https://www.v1.example/app.js", "body": "load('https://widget.intercom.io/w')"}))
    base = ["--profile", str(tmp_path / "p.json"), "--root", str(tmp_path / "out"), "--date", "2025-01-01"]
    assert cli.main([*base, "--pages", str(tmp_path / "pages.json"), "--scripts", str(tmp_path / "scripts.json")]) == 0
    sites = {r.name: r.site for r in runs.saved_records(spark, str(tmp_path / "out"), "valves", "2025-01-01").collect()}
    assert sites["Valve Works 0"] is None and sites["Valve Works 4"] is None  # outside the region; beyond the budget
    one = sites["Valve Works 1"]
    assert (one.title, one.tech, one.scripts_scanned, one.error, len(one.pages)) == ("Valves – A1", ["chat:intercom", "scheduler:calendly"], 1, None, 2) and "family owned" in one.text
    assert (sites["Valve Works 2"].error, sites["Valve Works 3"].error) == ("timeout", "page isn't staged")
    text = (tmp_path / "out" / "reports" / "2025-01-01.md").read_text()
    assert "npi failed" in text and "- Source failed (npi)" in text and "- Tools: chat: 1 present, 4 not known" in text
    search["sources"] = search["sources"][1:]
    (tmp_path / "p.json").write_text(json.dumps({"searches": {"valves": search}}))
    assert cli.main(["discover", *base]) == 3


def test_websites_by_name(spark):
    from firmscope.operators import sites
    from firmscope.sources.records import RECORD

    rows = [(f"r{i}", "a", n, None, w, (None, None, None, None, None), None, [], [], None, None) for i, (n, w) in enumerate([("Acme Valves", None), ("Bolt Works", "https://b.example"), ("Nowhere Pumps", None)])]
    hits = [("r0", 0, "https://yelp.com/acme", "Acme"), ("r0", 1, "https://www.acme-valves.example/x", "home"), ("r0", 2, "https://acme.example", "acme"), ("r2", 5, "https://nowhere.example", "Nowhere"), ("r1", 0, "https://bolt.example", "bolt works")]
    got = sites.find_websites(spark.createDataFrame(rows, RECORD), spark.createDataFrame(hits, "record_id string, pos int, url string, title string")).collect()
    assert {r.record_id: (r.website, len(r.evidence)) for r in got} == {"r0": ("https://acme-valves.example/", 1), "r1": ("https://b.example", 0), "r2": (None, 0)}


def test_filings_in_a_zip(spark, tmp_path):
    import zipfile

    from firmscope.functions.region import Region
    from firmscope.sources import registry

    head = "establishment_name,company_name,street_address,city,state,zip_code,naics_code,industry_description,establishment_type,annual_average_employees,year_filing_for"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("notes.txt", "x")
        z.writestr("data.csv", "\ufeff" + head + "\r\n" + 'Acme - Salem,"Acme, Inc.",1 A St,Salem,OR,97301,332911,Valves,1,12,2023\r\nFar,Far,2,Austin,TX,73301,332911,Valves,1,5,2023\r\n')
    rows = registry.READERS["osha_ita"](spark, {"path": str(tmp_path / "f.zip"), "naics": ["3329"]}, Region(regions=["OR"])).collect()
    assert [(r.employees, r.address.city) for r in rows] == [(12, "Salem")]


def test_hits_saved_awards_and_a_run_without_results(spark, tmp_path):
    """Websites come from search hits, purchases from saved answers of the award service; a search that keeps nothing still counts and reports."""
    bare = [{**r, "website": None} for r in RECORDS]
    for folder, name, rows in (
        ("records", "pumps", bare), ("records", "none", bare), ("hits", "pumps", [{"record_id": "a:1", "pos": 0, "url": "https://valve-works.example/x", "title": ""}]), ("hits", "none", [{"record_id": "x", "pos": 0, "url": "", "title": ""}]),
        ("buys", "pumps", [{"purpose": "market", "qpos": 0, "page": 1, "payload": json.dumps({"results": [{"Recipient Name": "VALVE WORKS 1 CO", "Awarding Agency": "Navy", "Award Amount": 9.5, "Award ID": "A1"}]})}]), ("buys", "none", [{"purpose": "market", "qpos": 0, "page": 1, "payload": "{}"}]),
    ):
        (tmp_path / folder / name).mkdir(parents=True)
        (tmp_path / folder / name / "a.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "pages.json").write_text(json.dumps({"url": "https://valve-works.example/", "html": "<title>Valves</title><p>family owned"}))
    search = {**PROFILE["searches"]["pumps"], "buyers": {"years": 5}, "coverage": {"naics": ["3329"], "counties": {"41": ["047", "039"]}}}
    table = [["ESTAB", "EMPSZES_LABEL", "NAICS2017_LABEL", "NAICS2017"], ["12", "All establishments", "Valves", "3329"], ["5", "Establishments with less than 5 employees", "Valves", "3329"], ["9", "All establishments", "Other", "9999"]]
    (tmp_path / "census" / "pumps").mkdir(parents=True)
    (tmp_path / "census" / "pumps" / "a.json").write_text(json.dumps(table))
    (tmp_path / "profile.json").write_text(json.dumps({"searches": {"pumps": search, "none": {**search, "include_any": ["no such word"], "coverage": {}}}}))
    base = ["--profile", str(tmp_path / "profile.json"), "--records", str(tmp_path / "records"), "--root", str(tmp_path / "out"), "--date", "2025-01-01"]
    assert cli.main([*base, "--hits", str(tmp_path / "hits"), "--pages", str(tmp_path / "pages.json"), "--purchases", str(tmp_path / "buys"), "--census", str(tmp_path / "census")]) == 0
    text = (tmp_path / "out" / "reports" / "2025-01-01.md").read_text()
    assert "listed against 12 establishments in 3329 (2022, 2 counties)" in text and "5 of them have under 20 employees" in text
    assert "4 records → 4 companies → 4 passed filters" in text and "4 records → 4 companies → 0 passed filters" in text and "Navy: $10 over 1 purchases" in text.replace("$9.50", "$10").replace("$9", "$10")
    found = {r.record_id: r.website for r in spark.read.parquet(str(tmp_path / "out" / "pumps" / "looked_up")).collect()}
    assert found["a:1"] == "https://valve-works.example/" and found["a:2"] is None
    sold = spark.read.option("header", True).csv(str(tmp_path / "out" / "pumps" / "exports" / "2025-01-01" / "purchases"))
    assert sold.columns[:5] == ["source", "buyer", "buyer_unit", "vendor", "listed_company"] and sold.first()["listed_company"].startswith("Valve Works 1")


def test_census_requests():
    from firmscope.sources import registry

    asked = registry.census_requests({"naics": [3329, "3331"], "counties": {"41": ["047", "039"], "53": ["011"]}, "year": 2021}, "k")
    assert len(asked) == 4 and asked[0]["url"].endswith("/2021/cbp") and asked[0]["params"]["for"] == "county:047,039" and asked[3]["params"]["NAICS2017"] == "3331" and asked[3]["params"]["in"] == "state:53"
    for bad in ({}, {"naics": ["1"]}, {"counties": {"1": ["2"]}}):
        with pytest.raises(registry.SourceError):
            registry.census_requests(bad, "k")


def test_a_lost_driver_is_no_failed_source(spark):
    def gone():
        raise ValueError("java.lang.OutOfMemoryError: Java heap space")

    with pytest.raises(ValueError):
        runs.discovered({"gone": gone})
    with pytest.raises(ZeroDivisionError):  # nor is a mistake of our own
        runs.discovered({"own": lambda: 1 / 0})
