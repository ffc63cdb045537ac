"""Decisions as VARIANT: what is wrong with each, and totals of awards as they stream in."""

import json

import pytest
from pyspark.sql import functions as F

from firmscope.operators import judging
from firmscope.streaming.market_stream import kept_up, running_totals

GOOD = {"account_id": "a", "decision": "keep", "fit": "strong", "fit_score": 4, "why_fit": [{"text": "t", "context_id": "c"}], "risks": ["r", 2], "draft": {"channel": "email", "subject": "s", "body": "b"}}


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "part int, answer string")


def test_faults(spark):
    texts = [
        json.dumps({"decisions": [GOOD, GOOD | {"risks": "one", "fit": "good"}, {}, "text"]}), json.dumps({"decisions": []}), json.dumps({"decisions": {}}), "[1", "", None, json.dumps({"decisions": [GOOD | {"risks": None, "draft": [], "fit": None, "fit_score": 2.0}]}),
    ]
    rows = {r.pos: r for r in judging.checked_answers(answers(spark, *texts)).collect()}
    assert rows[0].faults == [] and rows[0].risks == ["r", "2"] and rows[0].draft.body == "b" and rows[0].why_fit[0].text == "t"
    assert rows[1].risks == ["one"] and rows[1].faults == ["fit is none of strong, possible, none"]
    assert rows[2].faults == ["no account_id", "no decision"] and rows[3].faults == ["no account_id", "no decision"]
    assert 100000 not in rows and rows[200000].faults == ["no list of decisions"] and rows[300000].faults == rows[500000].faults == ["not JSON"]
    assert rows[600000].risks == [] and rows[600000].faults == ["draft has another type"] and rows[600000].fit_score == 2
    assert judging.checked_answers(spark.createDataFrame([], "part int, answer string")).count() == 0


def test_faults_raise_when_read(spark):
    assert [r.account_id for r in judging.read_decisions(answers(spark, json.dumps({"decisions": [GOOD]}))).collect()] == ["a"]
    with pytest.raises(Exception, match="decision 0: no decision"):
        judging.read_decisions(answers(spark, json.dumps({"decisions": [{"account_id": "a"}]}))).collect()


def test_saved_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join(json.dumps(GOOD | {"pos": p, "account_id": f"a{p}"}) for p in (3, 1)) + '\n\n{"pos": 7')
    rows = {r.pos: (r.account_id, r.faults) for r in judging.saved_decisions(spark, str(tmp_path)).collect()}
    assert rows == {3: ("a3", []), 1: ("a1", []), 0: (None, ["not JSON"])}


def test_late_and_repeated_awards(spark, tmp_path):
    """Three files are three batches: an award comes again in another batch, one comes late, buyers change twice."""
    batches = [
        [("a1", "x", "2025-01-10 00:00:00", 5.0), ("a2", "y", "2025-01-11 00:00:00", 1.5), ("a2", "y", "2025-01-11 00:00:00", 1.5)],
        [("a1", "x", "2025-01-10 00:00:00", 5.0), ("a3", "x", "2024-12-01 00:00:00", 2.0)],
        [("a4", "z", "2025-02-01 00:00:00", None), ("a3", "x", "2024-12-01 00:00:00", 2.0)],
    ]
    schema = "award string, buyer string, at timestamp, amount double"
    for i, rows in enumerate(batches):
        one = spark.createDataFrame(rows, "award string, buyer string, at string, amount double").withColumn("at", F.col("at").cast("timestamp"))
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.buyer: (r.n, float(r.total) if r.total is not None else None) for r in kept_up(running_totals(stream, "100 days"), str(tmp_path / "out")).collect()}
    assert got == {"x": (2, 7.0), "y": (1, 1.5), "z": (1, None)}
