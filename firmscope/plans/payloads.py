"""Queries of the source readers: saved payloads are made from whole tables, then read as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web as W
from ..functions.region import Region
from ..session import table
from ..sources import listings as L
from ..sources import registries as R
from ..sources import web_source

STATE = "case s_nationkey % 4 when 0 then 'OR' when 1 then 'new york' when 2 then 'WA' else '' end"


def _shown(rows: DataFrame) -> DataFrame:
    """A record's columns as texts and numbers, for comparison."""
    seen = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["kind"], e["detail"], e["date"], e["snippet"])), " ; ")
    return rows.select(
        "record_id", "name", F.coalesce("legal_name", F.lit("")).alias("legal_name"), F.coalesce("website", F.lit("")).alias("website"),
        F.concat_ws("|", "address.street", "address.city", "address.region", "address.postal_code", "address.country").alias("address"),
        F.array_join("categories", ",").alias("categories"), seen.alias("evidence"), F.col("employees"),
    )


def _suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("*", f"{STATE} as state", "case s_suppkey % 3 when 0 then 'SALEM' when 1 then 'Dayton' else '' end as city")


def src_npi(spark, sf_dir):
    """Registry pages of ten suppliers each; every third is an individual and is dropped, every fifth has a trade name."""
    s = _suppliers(spark, sf_dir)
    text = lambda c: c.cast("string")
    entry = F.struct(
        text(F.col("s_suppkey") % 80).alias("number"), F.when(F.col("s_suppkey") % 3 == 0, "NPI-1").otherwise("NPI-2").alias("enumeration_type"),
        F.struct(F.upper(F.concat("s_name", F.lit(" llc"))).alias("organization_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("2025-03-01")).alias("enumeration_date")).alias("basic"),
        F.when(F.col("s_suppkey") % 5 == 0, F.array(F.struct(F.lit("Doing Business As").alias("type"), F.concat(F.lit("Trade "), "s_suppkey").alias("organization_name")))).alias("other_names"),
        F.array(F.struct(F.lit("MAILING").alias("address_purpose"), F.lit("PO 1").alias("address_1"), F.lit("X").alias("city"), F.lit("TX").alias("state"), F.lit("1").alias("postal_code"), F.lit("US").alias("country_code")),
                F.struct(F.lit("LOCATION").alias("address_purpose"), F.concat(F.lit("1 Main "), "s_suppkey").alias("address_1"), F.col("city"), F.col("state"), F.lit("974011234").alias("postal_code"), F.lit("us").alias("country_code"))).alias("addresses"),
        F.array(F.struct(F.lit("Dentist").alias("desc")), F.struct(F.lit("").alias("desc"))).alias("taxonomies"),
    )
    page = F.floor(F.col("s_suppkey") / 10)
    pages = s.groupBy(page.alias("pos")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", entry.alias("e")))), lambda x: x["e"]).alias("results"))).alias("payload"))
    return _shown(R.npi(pages))


def src_osm(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("d", W.domain_of("url"))
    tags = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("name", "contact:website", "addr:housenumber", "addr:street", "addr:city", "addr:postcode", "shop")]),
        F.array(F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Site "), "page_id")), F.col("url"), (F.col("page_id") % 90).cast("string"), F.lit("Elm St"), F.lit("EUGENE"), F.lit("97401-22"), F.lit("pump")),
    )
    el = F.struct(F.when(F.col("page_id") % 2 == 0, "node").otherwise("way").alias("type"), F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.lit(44.5)).alias("lat"), F.when(F.col("page_id") % 2 == 0, F.lit(-123.1)).alias("lon"),
                  F.when(F.col("page_id") % 2 == 1, F.struct(F.lit(45.5).alias("lat"), F.lit(-122.5).alias("lon"))).alias("center"), tags.alias("tags"))
    payloads = p.groupBy(F.floor(F.col("page_id") / 50)).agg(F.to_json(F.struct(F.collect_list(el).alias("elements"))).alias("payload"))
    rows = R.osm(payloads, only_state="or")
    return _shown(rows).join(rows.select("record_id", F.col("coords.lat").alias("lat")), "record_id")


def src_csv(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("pos"), F.when(F.col("c_custkey") % 6 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.upper("c_name"))).alias("﻿Name "), F.lit("").alias("website"), F.lit("SALEM").alias("City"),
        F.lit("oregon").alias("region"), F.lit("97301-1").alias("postal_code"), F.concat(F.lower("c_mktsegment"), F.lit("; pumps ;")).alias("categories"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("note "), "c_custkey")).alias("note"),
    )
    return _shown(R.csv_list(c, "list", "my list"))


def src_osha(spark, sf_dir):
    """Parts as plant filings; of a plant's filings the last one counts."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" Works-SALEM Plant")).alias("establishment_name"), F.concat(F.initcap("p_name"), F.lit(" Group Inc")).alias("company_name"), F.lit("1 Elm").alias("street_address"),
        F.lit("Salem").alias("city"), F.when(F.col("p_partkey") % 2 == 0, F.lit("OR")).otherwise(F.lit("oregon")).alias("state"), F.when(F.col("p_partkey") % 7 == 0, F.lit("60601")).otherwise(F.lit("97301-55")).alias("zip_code"),
        F.concat(F.lit("33"), F.col("p_size") % 5).alias("naics_code"), F.lit("Valves").alias("industry_description"), F.when(F.col("p_partkey") % 9 == 0, "2").otherwise("1").alias("establishment_type"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("n/a")).otherwise(F.concat("p_size", F.lit(".0"))).alias("annual_average_employees"), F.lit("2024").alias("year_filing_for"),
    )
    return _shown(R.osha(p, ["331", "332"], Region(regions=["OR"], postal_prefixes=["97"])))


def src_directory(spark, sf_dir):
    """Customers as a start-up directory; a place in the region, or one that can't be told, is needed."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.concat(F.lit("c"), k).alias("slug"), F.concat(F.lit("https://c"), k, F.lit(".example.com")).alias("website"),
        F.when(k % 4 == 0, "Berlin, BE, Germany; Portland, OR, USA").when(k % 4 == 1, "Paris, France").when(k % 4 == 2, "OR, USA").otherwise("Remote").alias("all_locations"),
        F.col("c_mktsegment").alias("industry"), F.array(F.lit("B2B"), F.col("c_mktsegment")).alias("industries"), F.array(F.lit("SaaS")).alias("tags"), F.when(k % 5 != 0, (k % 300).cast("int")).alias("team_size"),
        F.when(k % 7 == 0, "Inactive").otherwise("Active").alias("status"), (k % 2 == 0).alias("isHiring"), F.concat(F.lit("Winter "), F.lit(2018) + (k % 8)).alias("batch"), F.lit("We make it").alias("one_liner"), F.concat(F.lit("https://dir.example/c"), k).alias("url"),
    )
    return _shown(R.yc(c, Region(regions=["OR"], countries=["US"]), industries=["building", "machinery"], low=5, high=250, since=2022))


def src_filings(spark, sf_dir):
    """Orders as filings in XML; of a customer's filings the latest sale counts, of equal ones the first."""
    o = table(spark, sf_dir, "orders")
    sale = F.date_format("o_orderdate", "yyyy-MM-dd")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><edgarSubmission xmlns="http://example.org/d"><primaryIssuer><entityName>Fund '), "o_custkey", F.lit(" Inc</entityName><issuerAddress><street1>1 A &amp; B</street1><city>SALEM</city><stateOrCountry>OR</stateOrCountry><zipCode>97301</zipCode></issuerAddress></primaryIssuer>"),
        F.lit("<offeringData><industryGroup><industryGroupType>"), F.when(F.col("o_custkey") % 3 == 0, "Pooled Investment Fund").otherwise("Other Technology"), F.lit("</industryGroupType></industryGroup><typeOfFiling><newOrAmendment><isAmendment>"),
        F.when(F.col("o_orderkey") % 5 == 0, "true").otherwise("false"), F.lit("</isAmendment></newOrAmendment><dateOfFirstSale><value>"), sale, F.lit("</value></dateOfFirstSale></typeOfFiling><offeringSalesAmounts><totalOfferingAmount>"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("Indefinite")).otherwise(F.floor("o_totalprice").cast("string")), F.lit("</totalOfferingAmount><totalAmountSold>1000</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"),
    )
    f = o.select(F.col("o_orderkey").alias("pos"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("0-1-"), "o_orderkey").alias("adsh"), F.when(F.col("o_orderkey") % 6 == 0, "D/A").otherwise("D").alias("form"), sale.alias("file_date"), xml.alias("xml"))
    return _shown(R.form_d(f, ["Other Technology"]))


def src_web(spark, sf_dir):
    """Pages as two providers' search answers; a domain's first title names it."""
    p = table(spark, sf_dir, "pages").withColumn("title", F.concat(F.lit("Pumps | "), F.split_part(W.domain_of("url"), F.lit("."), F.lit(1)), F.lit(" "), F.col("page_id") % 3))
    one = lambda text: F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.struct("title", "url", F.concat(F.lit("about "), "page_id").alias(text)).alias("r")))), lambda x: x["r"])
    half = lambda k: p.filter(F.col("page_id") % 2 == k).groupBy((F.floor(F.col("page_id") / 20) * 2 + k).alias("seq"), F.concat(F.lit("q "), F.floor(F.col("page_id") / 20)).alias("query"))
    brave = half(0).agg(F.to_json(F.struct(F.struct(one("description").alias("results")).alias("web"))).alias("payload"))
    tavily = half(1).agg(F.to_json(F.struct(one("content").alias("results"))).alias("payload"))
    found = L.search_results(brave, "brave").unionByName(L.search_results(tavily, "tavily"))
    return _shown(L.web_search(found, skip=["example.org"]))


def src_certified(spark, sf_dir):
    """Nations as certification listings: each page holds its suppliers, with one or two plants."""
    k = F.col("s_suppkey")
    block = F.concat(
        F.lit("<hr noshade><br><table><tr><td align='left'><font size='+2'>"), "s_name", F.lit(" &amp; Sons</font></td></tr><tr><td align='left'>1 Elm "), k, F.lit("</td></tr><tr><td align='left'>Salem, OR 97301-1234</td></tr><tr><td align=left>United States</td></tr><tr><td align='left'>503-555-01"), F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit("</td></tr><tr><td align=\"left\"><a href=\"http://s"), k, F.lit(".example.com\">Visit this company's website</a></td></tr></table><strong>Facility : </strong> "), F.when(k % 2 == 0, "Salem, OR").otherwise("Reno, NV"), F.lit("<br><font size=\"3\"><strong>Valves[1]</strong></font><td colspan=\"5\"><br><font size=\"2\"><strong>Check Valve</strong></font><td colspan=\"5\"><font size=\"2\"><strong>Size</strong></font>"),
        F.when(k % 3 == 0, F.lit("<strong>Facility : </strong>Boise, ID<br>")).otherwise(F.lit("")),
    )
    pages = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("pos")).agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("b")))), lambda x: x["b"]), "")).alias("html"))
    return _shown(L.nsf(pages.withColumn("url", F.lit("u")), "Listed", match=["check valve"]))


def src_awards(spark, sf_dir):
    """Lines as award pages of two queries; each award once, for the earlier query."""
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.concat(F.lit("V "), "o_custkey").alias("Recipient Name"), F.lit("DEPT").alias("Awarding Agency"), F.lit("Unit").alias("Awarding Sub Agency"), F.col("o_totalprice").alias("Award Amount"), F.col("o_orderpriority").alias("Description"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("Start Date"), F.concat(F.lit("A"), "o_orderkey").alias("Award ID"), F.concat(F.lit("G"), "o_orderkey").alias("generated_internal_id"))
    both = o.withColumns({"qpos": F.lit(1), "purpose": F.lit("market")}).filter("o_totalprice > 150000").unionByName(o.withColumns({"qpos": F.lit(2), "purpose": F.lit("c-1")}))
    pages = both.groupBy("purpose", "qpos", F.floor(F.col("o_orderkey") / 100).alias("page")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"]).alias("results"))).alias("payload"))
    return L.awards(pages, 1_000_000_000).select("key", "purpose", "vendor", "amount", "date", "award_id", "description")


def src_paged(spark, sf_dir):
    """All customers as saved answers of 25 requests, 20 entries a page; every third page falls short of that, and what was saved behind it isn't read."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.pmod("c_custkey", F.lit(25)).cast("long").alias("request"), F.floor(F.floor(F.col("c_custkey") / 25) / 20).cast("long").alias("page"))
    entry = F.struct(F.col("c_custkey").cast("string").alias("number"), F.lit("NPI-2").alias("enumeration_type"), F.struct(F.concat(F.lit("Clinic "), "c_custkey").alias("organization_name")).alias("basic"))
    some = F.filter(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))), lambda x: (F.col("page") % 3 < 2) | (F.floor(x["c_custkey"] / 25) % 20 < 15))
    pages = c.groupBy("request", "page").agg(F.to_json(F.struct(F.transform(some, lambda x: x["e"]).alias("results"))).alias("payload"))
    answers = pages.select("request", "page", F.lit("https://registry.example/").alias("url"), "payload", F.lit(None).cast("string").alias("error"))
    return R.npi_answers(web_source.usable(answers), 20).select("record_id", "name")


QUERIES = {f.__name__: f for f in (src_npi, src_paged, src_osm, src_csv, src_osha, src_directory, src_filings, src_web, src_certified, src_awards)}

_state = "CASE s_nationkey % 4 WHEN 0 THEN 'OR' WHEN 1 THEN 'NY' WHEN 2 THEN 'WA' END"
_city = "CASE s_suppkey % 3 WHEN 0 THEN 'Salem' WHEN 1 THEN 'Dayton' END"
ORACLE = {
    "src_paged": """WITH c AS (SELECT c_custkey AS k, c_custkey % 25 AS request, c_custkey // 25 // 20 AS page, c_custkey // 25 % 20 AS spot FROM customer), e AS (SELECT * FROM c WHERE page % 3 < 2 OR spot < 15),
        p AS (SELECT request, page, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT request, min(page) AS short FROM (SELECT r.request, q.page, coalesce(n, 0) AS n FROM (SELECT DISTINCT request FROM c) r JOIN (SELECT DISTINCT request, page FROM c) q USING (request) LEFT JOIN p ON p.request = r.request AND p.page = q.page) WHERE n < 20 GROUP BY request)
        SELECT 'npi:' || k AS record_id, 'Clinic ' || k AS name FROM e LEFT JOIN s USING (request) WHERE short IS NULL OR page <= short""",
    "src_npi": f"""SELECT 'npi:' || (s_suppkey % 80) AS record_id, CASE WHEN s_suppkey % 5 = 0 THEN 'Trade ' || s_suppkey ELSE replace(s_name, 'Supplier', 'Supplier') || ' LLC' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN s_name || ' LLC' ELSE '' END AS legal_name, '' AS website,
        concat_ws('|', '1 Main ' || s_suppkey, {_city}, {_state}, '97401', 'US') AS address, 'Dentist' AS categories, concat_ws(' ; ', 'registry|NPI ' || (s_suppkey % 80), CASE WHEN s_suppkey % 2 = 0 THEN 'registered|NPI enumerated 2025-03-01|2025-03-01' END) AS evidence, CAST(NULL AS INT) AS employees
        FROM supplier WHERE s_suppkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY s_suppkey % 80 ORDER BY s_suppkey) = 1""",
    "src_osm": """SELECT 'osm:' || t || '/' || page_id AS record_id, 'Site ' || page_id AS name, '' AS legal_name, url AS website, concat_ws('|', (page_id % 90) || ' Elm St', 'Eugene', 'OR', '97401') AS address, 'shop=pump' AS categories,
        'map_listing|OpenStreetMap ' || t || '/' || page_id AS evidence, CAST(NULL AS INT) AS employees, CASE WHEN t = 'node' THEN 44.5 ELSE 45.5 END AS lat FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'node' ELSE 'way' END AS t FROM pages) WHERE page_id % 4 <> 0""",
    "src_csv": """SELECT 'csv:list:' || (c_custkey + 1) AS record_id, c_name AS name, '' AS legal_name, '' AS website, 'Salem|OR|97301' AS address, lower(c_mktsegment) || ',pumps' AS categories,
        concat_ws('|', 'list_member', 'my list', CASE WHEN c_custkey % 2 = 0 THEN 'note ' || c_custkey END) AS evidence, CAST(NULL AS INT) AS employees FROM customer WHERE c_custkey % 6 <> 0""",
    "src_osha": """SELECT 'osha_ita:' || replace(p_name, ' ', '-') || '-works:97301' AS record_id, p_name || ' Works' AS name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') || ' Group Inc' AS legal_name, '' AS website, '1 Elm|Salem|OR|97301|US' AS address,
        'Valves,NAICS 33' || (p_size % 5) AS categories, 'osha_filing|OSHA 300A filing 2024: ' || CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE CAST(p_size AS VARCHAR) END || ' average employees' AS evidence, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS employees
        FROM part WHERE p_size % 5 IN (1, 2) AND p_partkey % 7 <> 0 AND p_partkey % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1""",
    "src_directory": """SELECT 'yc_directory:c' || k AS record_id, c_name AS name, '' AS legal_name, 'https://c' || k || '.example.com' AS website, CASE WHEN k % 4 = 0 THEN 'Portland|OR|US' ELSE 'OR|US' END AS address, c_mktsegment || ',B2B,' || c_mktsegment || ',SaaS' AS categories,
        concat_ws(' ; ', 'directory|Y Combinator Winter ' || (2018 + k % 8) || '|We make it', CASE WHEN k % 8 >= 4 THEN 'funded|Funded by Y Combinator (Winter ' || (2018 + k % 8) || ')|' || (2018 + k % 8) || '-01-01' END, CASE WHEN k % 2 = 0 THEN 'hiring|Hiring (YC directory)' END) AS evidence, k % 300 AS employees
        FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 7 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND k % 5 <> 0 AND k % 300 BETWEEN 5 AND 250 AND k % 4 IN (0, 2)""",
    "src_filings": """SELECT 'sec_form_d:' || o_custkey AS record_id, 'Fund ' || o_custkey || ' Inc' AS name, '' AS legal_name, '' AS website, '1 A & B|Salem|OR|97301|US' AS address, 'Other Technology' AS categories,
        'funded|Form D filed ' || d || ': sold $1,000 of a ' || CASE WHEN o_orderkey % 4 = 0 THEN 'an undisclosed amount' ELSE '$' || format('{:,d}', CAST(floor(o_totalprice) AS BIGINT)) END || ' offering|' || d AS evidence, CAST(NULL AS INT) AS employees
        FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) WHERE o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC, o_orderkey) = 1""",
    "src_web": r"""WITH r AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') AS d,
          ((page_id // 20) * 2 + page_id % 2) * 1000 + (page_id % 20) // 2 AS seq FROM pages)
        SELECT 'web_search:' || d AS record_id, split_part(d, '.', 1) || ' ' || (first(page_id ORDER BY seq) % 3) AS name, '' AS legal_name, 'https://' || d || '/' AS website, '' AS address, '' AS categories,
        string_agg('search_result|"q ' || (page_id // 20) || '"|about ' || page_id, ' ; ' ORDER BY seq) AS evidence, CAST(NULL AS INT) AS employees FROM r WHERE d <> 'example.org' AND NOT suffix(d, '.example.org') GROUP BY d""",
    "src_certified": """WITH s AS (SELECT *, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['x', 'y'] ELSE ['x'] END) AS u FROM supplier), f AS (SELECT *, CASE WHEN u = 'y' THEN 'Boise' WHEN s_suppkey % 2 = 0 THEN 'Salem' ELSE 'Reno' END AS fc, CASE WHEN u = 'y' THEN 'ID' WHEN s_suppkey % 2 = 0 THEN 'OR' ELSE 'NV' END AS fs FROM s)
        SELECT 'nsf:' || replace(lower(s_name), '#', '-') || '-sons:' || lower(fc) || '-' || lower(fs) AS record_id, s_name || ' & Sons' AS name, '' AS legal_name, 'http://s' || s_suppkey || '.example.com' AS website,
        concat_ws('|', CASE WHEN fc = 'Salem' THEN '1 Elm ' || s_suppkey END, fc, fs, CASE WHEN fc = 'Salem' THEN '97301' END, 'US') AS address, 'Valves,Check Valve' AS categories,
        'certification|Listed: plant in ' || fc || ', ' || fs || '|Certified products: Check Valve' || CASE WHEN fc = 'Salem' THEN '' ELSE ' | Company office: Salem, OR' END AS evidence, CAST(NULL AS INT) AS employees FROM f""",
    "src_awards": "SELECT 'G' || o_orderkey AS key, CASE WHEN o_totalprice > 150000 THEN 'market' ELSE 'c-1' END AS purpose, 'V ' || o_custkey AS vendor, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date, 'A' || o_orderkey AS award_id, o_orderpriority AS description FROM orders",
}
