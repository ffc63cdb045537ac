"""Filters, verdicts, exports, profiles, guards."""

import pytest
from pyspark.sql import functions as F

from firmscope.functions.region import Region
from firmscope.operators import accounts as A
from firmscope.operators import buyers, exports, judging, report, resolve, verdicts
from firmscope.plans import settings
from firmscope.sources import net, registries
from firmscope.sources.records import RECORD

EV = [("registered", "r", "u", "2025-01-10", None), ("registered", "r", "u", "bad-date", None), ("registered", "r2", "u", "2025-01-10T00:00", None), ("funded", "f", "u", None, None), ("funded", "g", "u", "2024-01-01", None), ("hiring", "h", None, None, None)]


def site(text):
    return ("https://s.example", None, None, text, None, None, ["chat:x"], None, False)


RECORDS = [
    ("a:1", "a", "Good Valve, Inc.", None, "https://good.example", (None, "Salem", "OR", None, "US"), None, ["valves"], EV, None, 10),
    ("a:2", "a", "Good Valve", None, None, (None, "Salem", "OR", None, "US"), "5", ["valves", "pumps"], [], None, 30),
    ("a:3", "a", "Far Valve", None, None, (None, "Berlin", None, None, "DE"), None, ["valves"], [], None, None),
    ("a:4", "a", "Bad Valve", None, None, (None, "Salem", "OR", None, "US"), None, ["valves", "casino"], [], None, None),
    ("a:5", "a", "Old Customer LLC", None, "old.example", (None, "Salem", "OR", None, "US"), None, ["valves"], [], None, 500),
]
POLICY = A.Policy(region=Region(regions=["OR"], countries=["US"]), include_any=["valve"], exclude_any=["casino"], exclude_companies=["old customer"], registered_within_days=30, funded=True, hiring=True, prefer_small=True)


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = spark.createDataFrame(RECORDS, RECORD)
    rows = rows.withColumn("site", F.when(F.col("record_id") == "a:1", F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("family owned").alias("text"), F.lit(None).cast("string").alias("error"), F.array(F.lit("chat:x")).alias("tech"), F.lit(False).alias("client_rendered"))))
    return A.evaluated(resolve.accounts(rows), POLICY, F.lit("2025-01-20").cast("date")).cache()


def test_filters(evaluated):
    got = {r.name: r for r in evaluated.collect()}
    assert set(got) == {"Good Valve", "Far Valve", "Bad Valve", "Old Customer LLC"}
    g = got["Good Valve"]
    assert g.passed and g.legal_name == "Good Valve, Inc." and g.employees == 30 and g.categories == ["valves", "pumps"]
    assert [s.detail for s in g.signals] == ["Registered 2025-01-10 (10 days ago)", "f", "g", "h"]
    assert g.score == 3 * 4 + 1 + 2 + 0 + 1 + 3
    assert [k for k, v in got["Far Valve"].filters.asDict().items() if not v] == ["in_region"]
    assert [k for k, v in got["Bad Valve"].filters.asDict().items() if not v] == ["no_exclude_terms"]
    assert [k for k, v in got["Old Customer LLC"].filters.asDict().items() if not v] == ["not_excluded"]


def test_verdict_and_exports(spark, evaluated, tmp_path):
    queue = A.judge_queue(evaluated, 5)
    good = queue.first()["account_id"]
    decision = (0, good, "keep", None, "strong", 9, "", [("w", "Pumps"), ("x", "nothing")], [("d", "u")], [" "], " r ", ("email", "s", "b" * 1300))
    d = spark.createDataFrame([decision, (1, good, "reject", None, "none", 1, "", [], [], [], "", None), (2, "unknown", "keep", None, "strong", 1, "", [], [], [], "", None)], "pos int, " + verdicts.DECISION)
    kept, rejected, stats = verdicts.enforced(queue, d, ["Pumps"], drafts=True, target=1)
    k = kept.first()
    assert (k.fit_score, len(k.why_fit), len(k.draft.body), k.contact_role) == (5, 1, 1200, "r") and k.risks[0].startswith("The judge stated")
    assert tuple(stats.first()) == (1, 0, 1) and rejected.count() == 0
    delivered = verdicts.deliver_top(evaluated, kept, 1)
    out = exports.account_export(delivered)
    assert out.columns == exports.ACCOUNT_COLUMNS and out.first()["city"] == "Salem"
    assert exports.write_csv(out, str(tmp_path / "a")) and not exports.write_csv(out.limit(0), str(tmp_path / "b"), only_if_rows=True)
    rows = kept.join(evaluated.select("account_id"), "account_id").withColumnRenamed("signals", "judge_signals")
    q = exports.draft_export(rows, "2025-01-20", "s").first()
    assert (q.status, q.evidence_urls, q.channel) == ("draft", "u", "email")
    part = report.section("Valves", "market_map", exports.funnel_line(evaluated, 5, kept, rejected), delivered, log=[("csv", "ok", 5, ""), ("npi", "failed", 0, "no file.")], notes=[report.coverage_text({"year": 2022, "codes": ["3329"], "counties": 2, "total": 8, "under_20": 3}, 1)])
    text = report.report("2025-01-20", [part], summary=[report.summary_line("Valves", "market_map", 1)])
    for piece in ("5 records → 4 companies → 1 passed filters → 1 kept → 0 rejected.", "| 1 | Good Valve | Salem, OR, US | 30 employees |", "Sources: csv 5, npi failed.", "- Source failed (npi): no file.", "1 listed against 8 establishments in 3329", "12 percent, 7 short", "- Valves: 1 companies", "(Monday)"):
        assert piece in text, piece
    assert exports.ACCOUNT_COLUMNS[12:19] == ["categories", "sources", "signals", "score", "region_status", "tech_status", "tech_detected"]
    draft = report.brief(delivered.join(kept.select("account_id", "what_they_do", "why_fit", "risks", "contact_role", "draft"), "account_id").first())
    assert "- Reach: r" in draft and "  > Subject: s" in draft and "- Fits: w [Pumps]" in draft
    assert report.coverage_text({"status": "failed", "error": "no key."}, 1) == "- Coverage: not checked (no key)." and report.tool_names(["chat:hubspot_chat", "x:a:b"]) == "hubspot chat, a:b"


def test_judge_seam(spark, evaluated):
    q = A.judge_queue(evaluated, 5)
    asked = []

    def judge(text):
        asked.append(text)
        return '{"decisions": [{"account_id": "good-example", "decision": "keep", "fit": "strong", "fit_score": 4}], "none_reason": ""}'

    d = judging.decided(q, judge, "rules")
    assert "<records>" in asked[0] and d.first()["fit_score"] == 4


def test_history(spark, tmp_path):
    runs = spark.createDataFrame([("2025-01-0" + str(i), "s", r, f"N{i}{r}") for i in (1, 2, 3) for r in range(1, 8)], "run_date string, search string, rank int, name string")
    runs = runs.withColumn("run_date", F.to_date("run_date"))
    for _ in range(2):  # a rerun replaces its own date
        exports.save_run(runs, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == 21
    assert {r.name[:2] for r in exports.recent_names(back, 1, "2025-01-03").collect()} == {"N2"}
    assert exports.index_cells(back).filter("run_date = '2025-01-01'").first()["cell"] == "N11, N12, N13, N14, N15 +2"


@pytest.mark.parametrize(("vendor", "want"), [
    ("VAL-MATIC VALVE & MFG CORP", "v"), ("DDB CHICAGO INC", None), ("MEMORIAL SLOAN-KETTERING", None), ("Sloan Valves of Ohio", "s"), ("VALVE COMPANY", "g"), ("Valve Company West", None), ("Chicago Valve and Control Group", "c"),
])
def test_vendor_match(spark, vendor, want):
    companies = spark.createDataFrame([("v", "Val-Matic Valve & Mfg. Corp.", 0), ("c", "Chicago Valves & Controls", 1), ("s", "Sloan Valve", 2), ("g", "Valve Company", 3)], "account_id string, name string, pos int")
    got = buyers.match_vendors(spark.createDataFrame([(vendor,)], "vendor string"), companies).collect()
    assert [r.account_id for r in got] == ([want] if want else [])


GOOD = {"searches": {"s": {"target_count": 5, "region": {"regions": ["OR"]}, "sources": [{"type": "npi"}]}}}


@pytest.mark.parametrize("change", [None, {}, {"searches": {}}, {"searches": {"s": {"goal": "x"}}}, {"searches": {"s": {}}}, {"searches": {"s": {"target_count": 1}}}, {"searches": {"s": {"target_count": 1, "region": {"a": 1}}}}, {"searches": {"s": {"target_count": 1, "region": {"a": 1}, "sources": [{"type": "x"}]}}}, GOOD | {"filters": {"knockouts": ["nope"]}}])
def test_bad_settings(change):
    with pytest.raises(settings.SettingsError):
        settings.checked(change)


def test_settings():
    s = settings.checked(GOOD)
    assert (s["s"].judge_limit, s["s"].suppresses, s["a_b"].label, s.window, s.ordered(["x", "s"])) == (10, True, "A B", 30, ["s", "x"])
    assert s["s"].policy.region.regions == ["OR"] and s["other"].policy.knockouts
    with pytest.raises(settings.SettingsError) as e:  # all faults at once, each with its place
        settings.checked({"searches": {"a": {"goal": "x"}, "b": {"target_count": 1, "region": {"cities": ["Salem"]}, "sources": [{"type": "?"}]}}, "filters": {"knockouts": ["nope"]}})
    assert [place for place, _ in e.value.faults] == ["", "a", "a", "a", "b"]


def test_overpass_query():
    q = registries.overpass_query([{"shop": "pump"}], ["Oregon"], 5)
    assert 'area["name"="Oregon"]->.a0;' in q and "out center tags 5;" in q
    with pytest.raises(ValueError, match="unsafe"):
        registries.overpass_query([{"shop": 'x"]'}], [], 5)
    with pytest.raises(ValueError, match="bbox"):
        registries.overpass_query([{"a": "b"}], [], 5, (1, 2))


def test_guards():
    private = lambda *_: [(0, 0, 0, "", ("10.0.0.1", 0))]
    public = lambda *_: [(0, 0, 0, "", ("93.184.215.14", 0))]
    assert net.check_url("https://h.example/", public)
    for url, resolve in (("https://h.example/", private), ("ftp://h.example/", public), ("http:///x", public)):
        with pytest.raises(net.NetError):
            net.check_url(url, resolve)


def test_profile_falls_back_and_context(tmp_path):
    import json

    (tmp_path / "p.example.json").write_text(json.dumps(GOOD | {"context": ["offer.md"]}))
    s = settings.load(tmp_path / "p.json")
    (tmp_path / "offer.md").write_text("# Offer\n\ntext\n## Pumps ##\n")
    assert settings.context_headings(s, tmp_path) == ["Offer", "Pumps"] and settings.context_headings(s) == ["offer.md"]
    (tmp_path / "offer.md").write_text("no headings")
    for folder in (tmp_path, tmp_path / "none"):
        with pytest.raises(settings.SettingsError):
            settings.context_headings(s, folder)
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(settings.SettingsError):
        settings.load(tmp_path / "bad.json")
    assert settings.checked({"searches": {"a": {**GOOD["searches"]["s"], "buyers": {"years": 5}}, "b": GOOD["searches"]["s"]}}).asking("buyers", ["b", "a"]) == ["a"]


def test_index_keeps_one_row_a_day(tmp_path):
    at = tmp_path / "index.md"
    for day, names in (("2025-01-01", "A"), ("2025-01-02", "B"), ("2025-01-01", "")):
        report.upsert_index(at, day, report.index_row(day, {"valves": names}))
    assert at.read_text().splitlines()[-2:] == ["| 2025-01-01 | 1 | valves: none |", "| 2025-01-02 | 1 | valves: B |"]


def test_lookups_keep_their_own(spark):
    rows = spark.createDataFrame([("market", None, 1), ("a", "a", 2), ("a", "b", 3), ("a", None, 4), ("market", "b", 5)], "purpose string, vendor_account_id string, k int")
    assert {r.k for r in buyers.own_lookups(rows).collect()} == {1, 2, 5}
