"""Edge cases that whole tables don't hold."""

import pytest
from pyspark.sql import functions as F

from firmscope.functions import text as T
from firmscope.functions import web as W
from firmscope.functions.region import Region, region_status


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in values.items())
    df = spark.createDataFrame([tuple(values[n] for n in names)], schema)
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("name", "want"), [
    ("92ND TERRACE DENTAL LLC", "92nd terrace dental"), ("Smith & Sons, Inc.", "smith and sons"), ("Acme (S14)", "acme"), ("Acme (Winter 2024)", "acme"), ("The Co.", ""), (None, ""),
])
def test_normalize_name(spark, name, want):
    assert one(spark, T.normalize_name("n"), n=name) == want


@pytest.mark.parametrize(("name", "want"), [
    ("OSPREY POINT CARE, PC", "Osprey Point Care, PC"), ("O'NEIL USA CNC", "O'neil USA CNC"), ("iRobot", "iRobot"), ("123", "123"), ("ACME (W21)", "Acme"),
])
def test_display_name(spark, name, want):
    assert one(spark, T.display_name("n"), n=name) == want


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.Example.com/x?y", "example.com"), ("example.com:8080", "example.com"), ("http://a_b.example/", "a_b.example"), ("http://u:p@h.example#f", "h.example"), ("", None), (None, None), ("www.www.x.y", "www.x.y"),
])
def test_domain_of(spark, url, want):
    assert one(spark, W.domain_of("u"), u=url) == want


@pytest.mark.parametrize(("href", "want"), [
    ("/about#team", "https://h.example/about"), ("//cdn.example/a", "https://cdn.example/a"), ("next", "https://h.example/a/next"), ("?q=1", "https://h.example/a/b?q=1"), ("mailto:x@y", "mailto:x@y"), ("", "https://h.example/a/b"),
])
def test_joined_url(spark, href, want):
    assert one(spark, W.joined_url("b", "h"), b="https://h.example/a/b", h=href) == want


@pytest.mark.parametrize(("label", "want"), [
    ("All establishments", None), ("Establishments with less than 5 employees", 4), ("5 to 1,009 employees", 1009), ("1,000 employees or more", 10**9), (None, None),
])
def test_label_bound(spark, label, want):
    assert one(spark, T.label_bound("x"), x=label) == want


@pytest.mark.parametrize(("name", "city", "want"), [
    ("Sloan-Franklin Park", "Franklin Park", "Sloan"), ("Faucets Company - Michigan City Plant", "Michigan City", "Faucets Company"), ("Salem", "Salem", "Salem"), ("A (b) c", "(b)", "A (b) c"), ("X Salemville", "Salem", "X Salemville"), ("X", None, "X"),
])
def test_plant_name(spark, name, city, want):
    assert one(spark, T.plant_name("n", "c"), n=name, c=city) == want


def test_seen_in(spark):
    assert one(spark, T.seen_in("n", F.col("b")), n="Hive", b="| archive labs | hive, inc") is True
    assert one(spark, T.seen_in("n", F.col("b")), n="Hive", b="archives beehive") is False
    assert one(spark, T.seen_in("n", F.col("b")), n="a\\Eb.", b="x a\\eb. y") is True


METRO = Region(regions=["Illinois"], countries=["US"], postal_prefixes=["606"], cities=["Skokie"], site_terms=["Chicago"])
BOX = Region(bbox=(40.0, -90.0, 43.0, -87.0), site_terms=["Ohio"])


@pytest.mark.parametrize(("region", "at", "want"), [
    (METRO, dict(country="DE"), "out"), (METRO, dict(state="WI"), "out"), (METRO, dict(state="IL", postal="60601"), "in"), (METRO, dict(state="IL", postal="61001"), "out"), (METRO, dict(state="IL", city="SKOKIE"), "in"),
    (METRO, dict(state="IL", city="Peoria"), "out"), (METRO, dict(state="IL"), "unknown"), (METRO, dict(text="in Chicago, since"), "in"), (METRO, dict(text="Chicagoland"), "unknown"), (METRO, dict(text="chicago"), "unknown"),
    (BOX, dict(lat=41.0, lon=-88.0), "in"), (BOX, dict(lat=50.0, lon=-88.0), "out"), (BOX, dict(text="of Ohio."), "in"), (Region(countries=["us"]), dict(country="us"), "in"), (Region(), dict(country="us"), "unknown"),
])
def test_region_status(spark, region, at, want):
    base = {"country": None, "state": None, "postal": None, "city": None, "text": None, "lat": None, "lon": None} | at
    df = spark.createDataFrame([tuple(base.values())], "country string, state string, postal string, city string, text string, lat double, lon double")
    assert df.select(region_status(region, "country", "state", "postal", "city", "lat", "lon", "text").alias("s")).first()["s"] == want


def test_page(spark):
    html = """<html><head><title> A &amp; B </title><meta content="we &lt;do&gt;" name="description"><style>x</style></head><body><script>var a="<p>";</script>
      <noscript>no</noscript><p>Write to a.b@c.example&nbsp;now</p><a href="/about-us#x">us</a><a href='http://www.h.example/products/'>p</a><a href="https://other.example/about">o</a><a href="/blog">b</a></body></html>"""
    cols = [W.page_title("h").alias("t"), W.page_description("h").alias("d"), W.page_text("h").alias("x"), W.useful_links("h", F.lit("http://h.example/")).alias("l")]
    r = spark.createDataFrame([(html,)], "h string").select(*cols).first()
    assert (r.t, r.d) == ("A & B", "we <do>")
    assert r.x == "Write to [email removed] now us p o b"
    assert r.l == ["http://h.example/about-us", "http://www.h.example/products/"]


def test_tool_status(spark):
    site = "struct<error:string,tech:array<string>,client_rendered:boolean>"
    rows = [(None,), (("x", ["chat:a"], False),), ((None, None, False),), ((None, ["chat:a"], True),), ((None, [], True),), ((None, ["tag_manager:g"], False),), ((None, ["scheduler:c"], False),)]
    got = [r.s for r in spark.createDataFrame(rows, f"site {site}").select(W.tool_status("site", "chat").alias("s")).collect()]
    assert got == ["unknown", "unknown", "unknown", "present", "unknown", "absent_unverified", "absent"]


def test_money_and_tail(spark):
    assert one(spark, T.money("x"), x=1234.5) == "$1,234"
    assert one(spark, T.with_tail(F.split("x", ","), 2), x="a,b,c") == "a, b +1"
