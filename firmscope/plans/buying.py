"""Registered queries over purchase records, long lists of domains, and looked-up websites, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buyers as B
from ..functions import web as W
from ..operators import domains as D
from ..operators import purchases as P
from ..operators.sites import find_websites
from ..session import table
from ..sources.records import EVIDENCE
from .names import DOMAIN

TODAY = "2025-01-31"


def _makers(spark, sf_dir) -> DataFrame:
    """All suppliers as listed companies; every seventh has a name without a telling word."""
    name = F.when(F.col("s_suppkey") % 7 == 0, "Valve Company").otherwise(F.concat(F.lit("Maker"), "s_suppkey", F.lit(" Valve Co")))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), "s_suppkey").alias("account_id"), name.alias("name"), F.col("s_suppkey").cast("long").alias("pos"))


def award_queries(spark, sf_dir):
    """The market query and the lookups of all suppliers."""
    return P.award_queries(_makers(spark, sf_dir), TODAY, 2, naics=[332911], states=["IL", "IN"], keywords=["valve"])


def award_lookups(spark, sf_dir):
    """All orders as awards. Each is found by three queries: the market (if dear), a stranger's lookup, and its own vendor's; answers come in pages.

    There are as many pages as hold about 100 of the market's awards, or a few of a lookup's, however many orders there are.
    """
    most = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("most")).crossJoin(table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("all_orders")))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(most)).withColumn("maker", F.col("o_custkey") % F.col("most") + 1)  # most is one row of two numbers
    key = F.concat(F.lit("G"), "o_orderkey")
    item = F.struct(
        F.concat(F.lit("MAKER"), "maker", F.lit(" VALVES LLC")).alias("Recipient Name"), F.lit("Department").alias("Awarding Agency"), F.col("o_orderstatus").alias("Awarding Sub Agency"), F.col("o_totalprice").alias("Award Amount"),
        F.col("o_orderpriority").alias("Description"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Start Date"), key.alias("Award ID"), F.when(F.col("o_orderkey") % 2 > 0, key).alias("generated_internal_id"),
    )
    asked = F.filter(F.array(F.when(F.col("o_totalprice") > 200000, F.lit(0)), F.col("maker") % F.col("most") + 2, F.col("maker") + 1), lambda q: q.isNotNull())
    found = o.select(F.explode(F.array_distinct(asked).cast("array<long>")).alias("qpos"), "most", "all_orders", key.alias("k"), item.alias("i"))
    of_query = F.ceil(F.col("all_orders") / F.when(F.col("qpos") == 0, F.lit(100)).otherwise(3 * (F.col("most") + 1)))
    pages = found.groupBy("qpos", F.pmod(F.xxhash64("k"), of_query).alias("page")).agg(F.sort_array(F.collect_list(F.struct("k", "i"))).alias("all"))
    answer = F.to_json(F.struct(F.col("all.i").alias("results"), F.struct(F.lit(True).alias("hasNext")).alias("page_metadata")))
    purpose = F.when(F.col("qpos") == 0, "market").otherwise(F.concat(F.lit("s-"), F.col("qpos") - 1))
    kept = P.kept_awards(pages.select(purpose.alias("purpose"), "qpos", "page", answer.alias("payload")), _makers(spark, sf_dir), 1 << 40)
    rows = B.labelled(kept, _makers(spark, sf_dir))
    return rows.select("key", "purpose", "vendor", "vendor_account_id", "listed_company", "label", "amount", "date", "description", "url")


CITY = {"domain": "data.example.gov", "dataset": "abcd-1234", "buyer": "City", "fields": {"vendor": "c_name", "unit": "c_mktsegment", "description": "o_orderpriority", "amount": "paid", "date": "o_orderdate", "id": "o_orderkey"}}


def city_asked(spark, sf_dir):
    """The query of a city's table for all suppliers."""
    return P.city_query(_makers(spark, sf_dir), CITY, ["valve", "o'ring"], "2023-02-01")


def city_given(spark, sf_dir):
    """All orders as a city's rows: empty vendors go, amounts that are no numbers count 0."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return P.city_rows(rows.withColumn("paid", F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))), CITY)


def long_skip_list(spark, sf_dir):
    """Pages outside a list of a domain for each order and line, which also holds every third page's own domain or the one above it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", W.domain_of("url").alias("domain"))
    many = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("https://www.l"), "l_orderkey", F.lit("."), "l_suppkey", F.lit(".example.org/x")).alias("domain"))
    some = pages.filter("page_id % 30 = 0").select(F.when(F.col("page_id") % 60 == 0, F.col("domain")).otherwise(F.array_join(F.slice(F.split("domain", "[.]"), 2, 9), ".")).alias("domain"))
    return D.without_listed(pages, many.unionAll(some)).select("page_id", "domain")


def found_websites(spark, sf_dir):
    """All customers as records, a fifth of them with a website, and search hits for each: a directory, a host or a title that names it, one too far down, none."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    records = c.select(F.concat(F.lit("r:"), key).alias("record_id"), F.concat(F.lit("Acme"), key, F.lit(" Co")).alias("name"), F.when(key % 5 == 0, "https://own.example/").alias("website"), F.array().cast(EVIDENCE).alias("evidence"))
    hit = lambda pos, url, title: F.struct(F.lit(pos).alias("pos"), url.alias("url"), title.alias("title"))
    none = F.lit(None).cast("string")
    named = F.concat(F.lit("https://www.ac-me"), key, F.lit("-shop.example/page"))
    hits = F.when(key % 4 == 0, F.array(hit(0, F.concat(F.lit("https://www.linkedin.com/acme"), key), none), hit(1, named, none))).when(key % 4 == 1, F.array(hit(0, F.lit("https://other.example/"), F.lit("Else")), hit(3, F.lit("https://titled.example/a"), F.concat(F.lit("ACME"), key, F.lit(" home")))))
    hits = hits.when(key % 4 == 2, F.array(hit(7, named, none))).otherwise(F.array(hit(0, F.lit("https://nothing.example/"), none)))
    found = find_websites(records, c.select(F.concat(F.lit("r:"), key).alias("record_id"), F.explode(hits).alias("h")).select("record_id", "h.*"))
    return found.select("record_id", "website", F.array_join("evidence.url", ",").alias("seen"))


QUERIES = {f.__name__: f for f in (award_queries, award_lookups, city_asked, city_given, long_skip_list, found_websites)}

_TAIL = '],"time_period":[{"start_date":"2023-02-01","end_date":"2025-01-31"}]'
_REST = '},"limit":100,"page":1,"sort":"Award Amount","order":"desc","fields":["Award ID","Recipient Name","Awarding Agency","Awarding Sub Agency","Award Amount","Description","Start Date","generated_internal_id"]}'
_HEAD = '{"filters":{"award_type_codes":["A","B","C","D"'
ORACLE = {
    "long_skip_list": f"""WITH p AS (SELECT page_id, {DOMAIN} AS domain FROM pages), l AS (SELECT CASE WHEN page_id % 60 = 0 THEN domain ELSE regexp_replace(domain, '^[^.]*[.]', '') END AS d FROM p WHERE page_id % 30 = 0)
        SELECT page_id, domain FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE p.domain = l.d OR ends_with(p.domain, '.' || l.d))""",
    "found_websites": """SELECT 'r:' || c_custkey AS record_id, CASE WHEN c_custkey % 5 = 0 THEN 'https://own.example/' ELSE found END AS website, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE coalesce(found, '') END AS seen
        FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'https://ac-me' || c_custkey || '-shop.example/' WHEN 1 THEN 'https://titled.example/' END AS found FROM customer)""",
    "award_queries": f"""SELECT 0::BIGINT AS qpos, 'market' AS purpose, '{_HEAD}{_TAIL},"naics_codes":{{"require":["332911"]}},"place_of_performance_locations":[{{"country":"USA","state":"IL"}},{{"country":"USA","state":"IN"}}],"keywords":["valve"]{_REST}' AS body
        UNION ALL SELECT s_suppkey + 1, 's-' || s_suppkey, '{_HEAD}{_TAIL},"recipient_search_text":["MAKER' || s_suppkey || '"]{_REST}' FROM supplier WHERE s_suppkey % 7 <> 0""",
    "award_lookups": """WITH o AS (SELECT *, o_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS maker FROM orders), l AS (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 7 <> 0)
        SELECT 'G' || o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'market' ELSE 's-' || maker END AS purpose, 'MAKER' || maker || ' VALVES LLC' AS vendor, CASE WHEN s IS NOT NULL THEN 's-' || s END AS vendor_account_id,
        CASE WHEN s IS NOT NULL THEN 'Maker' || s || ' Valve Co' END AS listed_company, 'Department / ' || o_orderstatus AS label, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS description,
        CASE WHEN o_orderkey % 2 > 0 THEN 'https://www.usaspending.gov/award/G' || o_orderkey ELSE '' END AS url FROM o LEFT JOIN l ON s = maker WHERE o_totalprice > 200000 OR s IS NOT NULL""",
    "city_asked": """SELECT 'https://data.example.gov/resource/abcd-1234.json' AS url, '(upper(o_orderpriority) like ''%VALVE%'' OR upper(o_orderpriority) like ''%O''''RING%'' OR ' || string_agg('upper(c_name) like ''%MAKER' || s_suppkey || '%''', ' OR ' ORDER BY '%MAKER' || s_suppkey || '%') || ') AND o_orderdate >= ''2023-02-01T00:00:00''' AS where,
        'o_orderdate DESC' AS order, 1000 AS limit FROM supplier WHERE s_suppkey % 7 <> 0""".replace("AS where", 'AS "where"').replace("AS order", 'AS "order"').replace("AS limit", 'AS "limit"'),
    "city_given": """SELECT 'socrata' AS source, 'City' AS buyer, coalesce(c_mktsegment, '') AS buyer_unit, c_name AS vendor, o_orderpriority AS description, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice::DECIMAL(18,2)::DOUBLE END AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date,
        o_orderkey::VARCHAR AS award_id, 'https://data.example.gov/d/abcd-1234' AS url FROM orders JOIN customer ON o_custkey = c_custkey""",
}
