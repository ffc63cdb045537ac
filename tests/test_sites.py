"""Websites looked up in search hits."""

from firmscope.operators import sites
from firmscope.sources.records import EVIDENCE


def test_host_of_a_hit_is_worked_out_once(spark):
    """Not once for each directory that it is compared with."""
    records = spark.createDataFrame([("a", "Acme Co", None, []), ("b", "Bolt Works", "https://own.example/", [])], f"record_id string, name string, website string, evidence {EVIDENCE}")
    hits = [("a", 0, "https://www.linkedin.com/acme", "Acme"), ("a", 1, "", "Acme"), ("a", 2, None, "Acme"), ("a", 3, "https://ac-me.example/x", None), ("a", 4, "https://acme.example/", None), ("b", 0, "https://bolt.example/", None)]
    found = sites.find_websites(records, spark.createDataFrame(hits, "record_id string, pos int, url string, title string"))
    assert sorted((r.record_id, r.website) for r in found.collect()) == [("a", "https://ac-me.example/"), ("b", "https://own.example/")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(url") <= 2
