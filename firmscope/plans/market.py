"""Queries of the account pipeline over whole tables: signals, filters, verdicts, purchases, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..functions.region import Region
from ..operators import accounts as A
from ..operators import searches as S
from ..operators import buyers as B
from ..operators import exports, resolve, verdicts
from ..operators.judging import checked_answers, texts_of
from ..operators.staging import staged
from ..session import table
from ..sources.listings import census_rows, city_purchases, queries_for
from ..sources.records import RECORD, first_wins, union_all
from .names import COMPANY, DOMAIN, TOKENS, _sql_text, sql_decoded, sql_list, sql_words

RUN_DAY = "2024-01-20"

def _day():
    return F.lit(RUN_DAY).cast("date")



# ---------------------------------------------------------------- signals over events

KIND = "case event_type when 'click' then 'registered' when 'purchase' then 'funded' when 'view' then 'hiring' else event_type end"
DATE = "case when event_id % 5 = 0 then '2024-1-2' when event_id % 7 = 0 then '' else left(cast(ts as string), 10) end"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{KIND} as kind", f"{DATE} as date", "concat(event_type, ' by ', user_id % 10) as detail")
    item = F.struct("event_id", F.struct("kind", "detail", F.lit("").alias("url"), "date", F.lit("").alias("snippet")).alias("e"))
    return ev.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("all")).select("user_id", F.col("all.e").alias("evidence"))


def _signals(spark, sf_dir, policy: A.Policy) -> DataFrame:
    rows = _evidence(spark, sf_dir).select("user_id", F.posexplode(A.signals_for(policy, _day(), F.col("evidence"))).alias("pos", "s"))
    return rows.select("user_id", F.col("pos").cast("long").alias("pos"), "s.kind", "s.detail")


def signals_recent(spark, sf_dir):
    return _signals(spark, sf_dir, A.Policy(registered_within_days=9))


def signals_funded(spark, sf_dir):
    return _signals(spark, sf_dir, A.Policy(funded_within_days=5, hiring=True))


def first_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return first_wins(ev, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def last_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# ---------------------------------------------------------------- documents as accounts

INCLUDE, EXCLUDE = ["license", "copyright", r"\bthe\b"], ["confidential", "idiot"]


def _accounts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = F.size(T.pattern_hits("text", INCLUDE))
    labels = table(spark, sf_dir, "labels")
    a = docs.select("doc_id", "lang", "source", hits.alias("hits"), (F.size(T.pattern_hits("text", EXCLUDE)) == 0).alias("no_exclude_terms"))
    a = a.join(labels, "doc_id", "left").withColumns({"sig": F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)), "in_region": F.coalesce(F.col("lang") == "en", F.lit(False))})
    a = a.withColumns({"relevant": F.col("hits") > 0, "signal_ok": F.col("sig") >= 1, "not_excluded": F.coalesce(F.col("toxic"), F.lit(0)) == 0, "account_id": F.concat(F.lit("doc-"), "doc_id"), "name": F.concat("source", F.lit(" "), "doc_id")})
    passed = F.lit(True)
    for k in ("in_region", "relevant", "no_exclude_terms", "not_excluded"):
        passed = passed & F.col(k)
    return a.withColumns({"passed": passed, "score": 3 * F.col("sig") + F.least("hits", F.lit(5)) + 2 + F.col("in_region").cast("int")})


_ACC = r"""acc AS (SELECT *, in_region AND relevant AND no_exclude_terms AND not_excluded AS passed, 3 * sig + least(hits, 5) + 2 + in_region::INT AS score FROM (
  SELECT d.doc_id, d.source, regexp_matches(text, '(?i)license')::INT + regexp_matches(text, '(?i)copyright')::INT + regexp_matches(text, '(?i)\bthe\b')::INT AS hits,
    NOT regexp_matches(text, '(?i)confidential') AND NOT regexp_matches(text, '(?i)idiot') AS no_exclude_terms, coalesce((quality = 1)::INT, 0) AS sig, quality, toxic, coalesce(lang = 'en', false) AS in_region,
    hits > 0 AS relevant, sig >= 1 AS signal_ok, coalesce(toxic, 0) = 0 AS not_excluded, 'doc-' || d.doc_id AS account_id, source || ' ' || d.doc_id AS name
  FROM documents d LEFT JOIN labels l USING (doc_id)))"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY passed DESC, score DESC, lower(name), account_id) AS rank FROM acc)"
_QUEUE = "queue AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, lower(name), account_id) AS qrank FROM acc WHERE passed QUALIFY qrank <= 12)"


def filters_struct(spark, sf_dir):
    return _accounts(spark, sf_dir).select("doc_id", "in_region", "relevant", "no_exclude_terms", "not_excluded", "signal_ok")


def knockouts(spark, sf_dir):
    return _accounts(spark, sf_dir).select("doc_id", "passed", "score")


def ranked_accounts(spark, sf_dir):
    """Every account's rank within its source; each source is a search of its own."""
    return A.ranked(_accounts(spark, sf_dir), ["source"]).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def _queue(spark, sf_dir) -> DataFrame:
    return A.judge_queue(_accounts(spark, sf_dir), 12, ["source"])


def judge_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("source", "account_id", F.col("rank").cast("long").alias("rank"))


def judge_batches(spark, sf_dir):
    q = _queue(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy("source", "rank")))  # a queue is bounded by searches times their limit
    return verdicts.batches(q, 20).groupBy("part", "parts").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"))


def _decisions(spark, sf_dir) -> DataFrame:
    """Labels as a judge's decisions: some repeat, some name accounts that aren't queued, some cite what isn't in the context."""
    labels = table(spark, sf_dir, "labels")
    d = labels.select(
        (F.col("doc_id") * 2).alias("pos"), F.concat(F.lit("doc-"), "doc_id").alias("account_id"), F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("decision"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("weak fit")).alias("reject_reason"), F.when(F.col("doc_id") % 4 == 0, "strong").when(F.col("doc_id") % 4 == 1, "none").otherwise("possible").alias("fit"),
        (F.col("doc_id") % 9).cast("int").alias("fit_score"), F.when(F.col("doc_id") % 2 == 0, F.lit("makes things")).alias("what_they_do"),
        F.array(F.struct(F.lit("a").alias("text"), F.lit("Offer / Pumps").alias("context_id")), F.struct(F.lit("b").alias("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("Markets")).otherwise(F.lit("made up")).alias("context_id"))).alias("why_fit"),
        F.array(F.struct(F.lit("new site").alias("detail"), F.lit("").alias("url"))).alias("signals"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("small"))).alias("risks"),
        F.lit(" buyer ").alias("contact_role"), F.struct(F.lit("email").alias("channel"), F.lit("hello").alias("subject"), F.lit("text").alias("body")).alias("draft"),
    )
    again = d.withColumns({"pos": F.col("pos") + 1, "decision": F.lit("reject")}).filter("pos % 3 = 0")
    return d.unionByName(again)


def _enforced(spark, sf_dir, target=None):
    q = _queue(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy("source", "rank")))
    return verdicts.enforced(q, _decisions(spark, sf_dir), ["Pumps", "Markets"], drafts=True, target=target)


def verdict_kept(spark, sf_dir):
    kept, _, _ = _enforced(spark, sf_dir)
    return kept.select("account_id", "fit", "fit_score", "what_they_do", F.size("why_fit").alias("cited"), F.array_join("risks", "; ").alias("risks"), "contact_role", F.col("draft.subject").alias("draft"))


def verdict_rejected(spark, sf_dir):
    """Rejections with their reasons, those ranked below the target among them."""
    _, rejected, _ = _enforced(spark, sf_dir, target=10)
    return rejected.select("account_id", "reason")


def judge_stats(spark, sf_dir):
    return _enforced(spark, sf_dir)[2]


def deliver_topn(spark, sf_dir):
    kept, _, _ = _enforced(spark, sf_dir, target=25)
    rows = verdicts.deliver_top(_accounts(spark, sf_dir), kept, 25)
    return rows.select("account_id", F.col("place").cast("long").alias("place"), "fit_score")


def deliver_map(spark, sf_dir):
    kept, rejected, _ = _enforced(spark, sf_dir)
    a = A.ranked(_accounts(spark, sf_dir), ["source"]).withColumn("rank", F.struct("source", "rank"))
    return verdicts.deliver_map(a, kept, rejected).select("account_id", F.col("place").cast("long").alias("place"))


def funnel(spark, sf_dir):
    return _accounts(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if("relevant").alias("relevant"), F.count_if("passed").alias("passed"))


def export_accounts(spark, sf_dir):
    a = A.ranked(_accounts(spark, sf_dir), ["source"]).filter("passed")
    return a.select(F.col("rank").cast("long").alias("rank"), "account_id", "name", F.array_join(F.array(F.lit("documents"), "source"), "; ").alias("sources"), F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("fit"), T.money(F.col("score") * 1234.5).alias("score"))


def index_rows(spark, sf_dir):
    a = A.ranked(_accounts(spark, sf_dir).filter("passed"), ["source"])
    return exports.index_cells(a.select(_day().alias("run_date"), F.col("source").alias("search"), "rank", "name")).select(F.col("search").alias("source"), "cell")


def excluded(spark, sf_dir):
    """Suppliers against a do-not-contact list, the customers in debt, by normalised name."""
    listed = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(T.normalize_name(F.concat(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.lit(", Inc."))).alias("n")).distinct()
    s = table(spark, sf_dir, "supplier").withColumn("n", T.normalize_name(F.upper("s_name"))).join(listed.withColumn("hit", F.lit(True)), "n", "left")
    return s.select("s_suppkey", F.coalesce("hit", F.lit(False)).alias("excluded"))


def seen_recent(spark, sf_dir):
    """Parts whose name stood in one of the last seven histories (a day's searches by its events)."""
    runs = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("user_id").alias("k"))
    last = runs.orderBy(F.desc("day")).limit(7)
    parts = table(spark, sf_dir, "part")
    shown = last.join(parts, F.col("k") == F.col("p_partkey")).select("p_name")
    blob = shown.agg(F.array_join(F.array_sort(F.collect_list(F.lower("p_name"))), " | ").alias("blob"))  # seven short texts
    return parts.crossJoin(F.broadcast(blob)).select("p_partkey", T.seen_in("p_name", F.col("blob")).alias("seen"))


# ---------------------------------------------------------------- resolution and sites

def _page_records(spark, sf_dir, torn: bool = False) -> DataFrame:
    """Pages as records: with `torn`, a third have no website and link by a short name, also between domains."""
    pages = table(spark, sf_dir, "pages").withColumn("d", W.domain_of("url"))
    name = F.concat(F.lit("Site "), F.col("page_id") % 40, F.when(F.col("page_id") % 2 == 0, F.lit(", Inc.")).otherwise(F.lit(""))) if torn else F.concat(F.lit("Page "), "page_id")
    site = F.when(F.col("page_id") % 3 != 0, F.col("url")) if torn else F.col("url")
    none = F.lit(None).cast("string")
    return pages.select(
        F.concat(F.lit("web:"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("record_id"), F.when(F.col("page_id") % 2 == 0, "web_search").otherwise("csv").alias("source"), name.alias("name"), none.alias("legal_name"),
        site.alias("website"), F.struct(none.alias("street"), F.when(F.col("page_id") % 5 == 0, F.lit("Salem")).alias("city"), none.alias("region"), none.alias("postal_code"), none.alias("country")).alias("address"),
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("+1 "), "page_id")).alias("phone"), F.array(F.split_part("d", F.lit("."), F.lit(-1)), F.concat(F.lit("k"), F.col("page_id") % 3)).alias("categories"),
        F.array().cast("array<struct<kind:string,detail:string,url:string,date:string,snippet:string>>").alias("evidence"), F.lit(None).cast("struct<lat:double,lon:double>").alias("coords"),
        F.when(F.col("page_id") % 7 == 0, F.col("page_id").cast("int")).alias("employees"),
    )


def er_edges(spark, sf_dir):
    keys = resolve.keyed(_page_records(spark, sf_dir, torn=True)).select("record_id", F.explode("keys").alias("key"))
    return keys.groupBy("key").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))


def er_groups(spark, sf_dir):
    return resolve.groups(_page_records(spark, sf_dir, torn=True))


def er_torn_accounts(spark, sf_dir):
    """Accounts of the records that the ordered rule groups: the first with a website names it."""
    a = resolve.accounts(_page_records(spark, sf_dir, torn=True))
    return a.select("domain", "name", "website", F.array_join("record_ids", ",").alias("record_ids"), F.array_join("sources", ",").alias("sources"), "employees", F.col("address.city").alias("city"))


def er_accounts(spark, sf_dir):
    a = resolve.accounts(_page_records(spark, sf_dir))
    return a.select("account_id", "domain", "name", "website", "phone", "employees", F.array_join("sources", ",").alias("sources"), F.array_join("categories", ",").alias("categories"), F.size("record_ids").alias("n"), F.col("address.city").alias("city"))


PAGES_POLICY = A.Policy(region=Region(site_terms=["Page 1", "Page 3"]), region_strict=True, include_any=["page [0-9]+", r"\bk1\b", "net"], exclude_any=["page 11"], exclude_domains=["https://www.spam-farm.example.org/"], require_website=True, prefer_small=True)


def account_filters(spark, sf_dir):
    """Pages resolved to accounts, then every filter, the verdict of the knock-outs, score and rank in one plan."""
    rows = _page_records(spark, sf_dir).withColumn("site", F.lit(None).cast("struct<url:string,title:string,description:string,text:string,error:string,tech:array<string>,client_rendered:boolean>"))
    a = A.ranked(A.evaluated(resolve.accounts(rows), PAGES_POLICY, _day()))
    return a.select("account_id", "region_status", F.array_join("keyword_hits", ",").alias("hits"), "size_band", "filters.relevant", "filters.no_exclude_terms", "filters.not_excluded", "passed", "score", F.col("rank").cast("long").alias("rank"))


SEARCHES = {
    "pages": PAGES_POLICY,
    "sevens": A.Policy(region=Region(site_terms=["Page 7"]), include_any=["page [0-9]*7"], exclude_any=[r"\bk2\b", "page 27"], exclude_companies=["page 17"]),
    "all": A.Policy(region=Region(cities=["Salem"]), min_signals=0, require_website=True, prefer_small=True, knockouts=["has_website"]),
}


def _all_ranked(spark, sf_dir) -> DataFrame:
    rows = _page_records(spark, sf_dir).withColumn("site", F.lit(None).cast("struct<url:string,title:string,description:string,text:string,error:string,tech:array<string>,client_rendered:boolean>"))
    policies = S.policy_table(spark, SEARCHES)
    each = staged(resolve.accounts(rows), "accounts").crossJoin(F.broadcast(policies.select("search")))  # here all searches found the same records
    return S.ranked_all(S.evaluated_all(each, policies, _day()))


def all_searches(spark, sf_dir):
    """Three searches' filters, scores and ranks in one plan, with their rules as data."""
    return _all_ranked(spark, sf_dir).select("search", "account_id", "region_status", F.array_join("keyword_hits", ",").alias("hits"), "filters.relevant", "filters.no_exclude_terms", "filters.not_excluded", "passed", "score", F.col("rank").cast("long").alias("rank"))


def search_funnels(spark, sf_dir):
    return S.funnels(_all_ranked(spark, sf_dir)).select("search", "accounts", "in_region", "relevant", "no_exclude_terms", "not_excluded", "passed", "best")


def site_budget(spark, sf_dir):
    """Pages of the first twenty domains, in page order."""
    pages = table(spark, sf_dir, "pages").select("page_id", W.domain_of("url").alias("domain"))
    first = pages.groupBy("domain").agg(F.min("page_id").alias("at")).orderBy("at").limit(20)
    return pages.join(first, "domain", "left").select("page_id", "domain", F.col("at").isNotNull().alias("read"))


def site_read(spark, sf_dir):
    """The first three pages of each domain as one text, each page and the whole cut to size."""
    pages = table(spark, sf_dir, "pages").select("page_id", W.domain_of("url").alias("domain"), F.left(W.page_text("html", closed=True), F.lit(2500)).alias("text"))
    few = pages.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("page_id"))).filter("r <= 3")
    joined = few.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n\n").alias("t"), F.count(F.lit(1)).alias("pages"))
    return joined.select("domain", "pages", F.md5(F.left("t", F.lit(6000))).alias("digest"))


def enrich_counters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(W.domain_of("url").alias("domain"), F.length(W.page_text("html", closed=True)).alias("n"))
    return pages.agg(F.countDistinct("domain").alias("sites"), F.count_if(F.col("n") < 300).alias("thin"))


def website_lookup(spark, sf_dir):
    """For each part the first page whose host or title shares a telling word with its name (by words, never all pairs)."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace(W.domain_of("url"), F.lit("-"), F.lit("")).alias("d"), F.lower(W.page_title("html", closed=True)).alias("t"))
    words = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "d", "t"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).groupBy("word").agg(F.min("page_id").alias("page_id"))
    names = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.distinctive_tokens("text")).alias("word"))
    return names.join(words, "word").groupBy("doc_id").agg(F.min("page_id").alias("page_id"))


# ---------------------------------------------------------------- purchases

def _companies(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat('c-', p_partkey) as account_id", f"{COMPANY} as name", "p_partkey as pos")


def vendor_match(spark, sf_dir):
    vendors = table(spark, sf_dir, "part").selectExpr(f"concat({COMPANY}, case p_partkey % 3 when 0 then ' Holdings' else '' end) as vendor")
    return B.match_vendors(vendors, _companies(spark, sf_dir))


def vendor_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fields = {"id": "o_orderkey", "vendor": "c_name", "description": "o_orderpriority", "amount": "o_totalprice", "date": "o_orderdate"}
    return city_purchases(rows, fields, ["urgent"], ["%CUSTOMER%00%7"], "1998-01-01").select("award_id", "vendor", "description", "amount", "date")


def award_dedup(spark, sf_dir):
    """Orders found by two queries count once, for the earlier query."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = union_all([orders.filter("o_custkey % 3 = 0").withColumn("q", F.lit(2)), orders.filter("o_totalprice > 200000").withColumn("q", F.lit(1))])
    return first_wins(found, ["o_orderkey"], [F.col("q")]).select("o_orderkey", "q")


def _purchases(spark, sf_dir) -> DataFrame:
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    p = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    unit = F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).when(F.col("n_nationkey") % 5 == 1, F.lower("r_name")).otherwise(F.col("n_name"))
    matched = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("s-"), "s_suppkey"))
    return p.select(F.col("r_name").alias("buyer"), unit.alias("buyer_unit"), F.col("s_name").alias("vendor"), matched.alias("vendor_account_id"), F.col("l_extendedprice").alias("amount"))


def _labelled(spark, sf_dir):
    companies = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), "s_suppkey").alias("account_id"), F.concat(F.lit("Listed "), "s_suppkey").alias("name"))
    return B.labelled(_purchases(spark, sf_dir), companies)


def top_buyers(spark, sf_dir):
    return B.top_buyers(_labelled(spark, sf_dir)).select("label", "total", "count", F.array_join("vendors", "; ").alias("vendors"))


def other_vendors(spark, sf_dir):
    return B.other_vendors(_labelled(spark, sf_dir)).select("vendor", "total", "count", F.array_join("buyers", "; ").alias("buyers"))


def by_company(spark, sf_dir):
    return B.by_company(_labelled(spark, sf_dir)).select(F.col("vendor_account_id").alias("account_id"), "total", "count", T.with_tail(F.col("buyers"), 3).alias("buyers"))


def listed_purchases(spark, sf_dir):
    rows = _labelled(spark, sf_dir).filter("amount > 60000")
    return rows.groupBy(F.coalesce("listed_company", F.lit("")).alias("listed_company")).agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("most"))


def coverage_rollup(spark, sf_dir):
    """Customers by segment as census responses (an array of arrays a nation), read back and rolled up."""
    c = table(spark, sf_dir, "customer")
    size = F.when(F.col("c_custkey") % 4 == 0, "All establishments").when(F.col("c_custkey") % 4 == 1, "Establishments with less than 5 employees").when(F.col("c_custkey") % 4 == 2, "Establishments with 10 to 19 employees").otherwise("Establishments with 1,000 employees or more")
    head = F.array(*[F.lit(h) for h in ("ESTAB", "EMPSZES_LABEL", "NAICS2017_LABEL", "NAICS2017", "state")])
    row = F.array((F.col("c_custkey") % 50).cast("string"), size, F.concat(F.lit("Label "), "c_mktsegment"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    payloads = c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000)).agg(F.to_json(F.concat(F.array(head), F.collect_list(row))).alias("payload"))
    return B.coverage(census_rows(payloads))


def search_queries(spark, sf_dir):
    templates = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lower("n_name"), F.lit(" valves {place}"))).otherwise(F.lower("n_name")).alias("template"))
    return queries_for(templates, table(spark, sf_dir, "region").select(F.initcap("r_name").alias("place")))


def source_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    rows = union_all([s, c])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("nation").alias("nations"), F.count("segment").alias("segments"), F.when(F.count(F.lit(1)) > 0, "ok").otherwise("failed").alias("status"))


def tags_union(spark, sf_dir):
    """Words of each brand's names: how many, and which of three they have or lack; only those three are gathered."""
    words = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    base = F.array(F.lit("red"), F.lit("bolt"), F.lit("nothing"))
    per = words.groupBy("p_brand").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.when(F.array_contains(base, F.col("w")), F.col("w")))).alias("both"))
    return per.select("p_brand", "n", (F.size("both") > 0).alias("any"), F.array_join("both", ",").alias("both"), F.array_join(F.array_sort(F.array_except(base, "both")), ",").alias("missing"))


def date_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    since = F.date_sub(F.lit("2001-01-01").cast("date"), 365 * 2)
    return o.filter(day >= since).groupBy(F.date_format(day, "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.max(F.left(F.col("o_orderdate").cast("string"), F.lit(10))).alias("last"))


def latest_filing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return first_wins(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


def largest_awards(spark, sf_dir):
    """A top-k report: the hundred largest lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return line.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


def account_view(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.left("text", F.lit(3000))).alias("digest"), F.floor(F.length("text") / 4).alias("tokens"))


def early_prune(spark, sf_dir):
    """Events of listed parts: what can't qualify is dropped before the join."""
    ev = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value > 5").select("user_id", "value")
    p = table(spark, sf_dir, "part").filter("p_size < 25").select("p_partkey", "p_brand")
    return ev.join(p, F.col("user_id") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def risks_coerced(spark, sf_dir):
    """A field that is a text in some rows and a list in others, as one list."""
    raw = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("r"), "doc_id").alias("risks")))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.array(F.lit("a"), F.col("quality").cast("string")).alias("risks")))).otherwise(F.lit("{}")).alias("j"))
    some = texts_of(F.try_variant_get(F.parse_json("j"), "$.risks", "variant"))
    return raw.select("doc_id", F.array_join(some, "; ").alias("risks"))


def decision_faults(spark, sf_dir):
    """Labels as a judge's answers, sound and not: what is wrong with each."""
    k = F.col("doc_id") % 7
    good = F.to_json(F.struct(F.concat(F.lit("a-"), "doc_id").alias("account_id"), F.when(k == 1, "maybe").otherwise("keep").alias("decision"), F.lit("strong").alias("fit"), F.col("quality").alias("fit_score")))
    one = F.when(k == 2, F.concat(F.lit('{"decision":"keep","fit_score":"high","why_fit":"text","n":'), F.col("doc_id").cast("string"), F.lit("}"))).when(k == 3, '{"account_id":"x","decision":null,"risks":3}').otherwise(good)
    answer = F.when(k == 4, '{"decisions": [').when(k == 5, '{"none_reason": "none"}').otherwise(F.concat(F.lit('{"decisions":['), one, F.lit(']}')))
    rows = checked_answers(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("part"), answer.alias("answer")))
    return rows.select("pos", "account_id", "fit_score", F.array_join("faults", "; ").alias("faults"))


def conversation_postings(spark, sf_dir):
    """Conversations as postings: a company's first turn places it, all its turns are evidence."""
    from ..sources.registries import postings

    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat(F.lit("ACME "), F.col("conv_id") % 40, F.lit(" LLC")).alias("company"), F.concat(F.col("role"), F.lit(" "), "turn").alias("title"), F.lit("").alias("url"),
        F.when(F.col("turn") % 2 == 0, F.lit("Dayton, OH")).otherwise(F.lit("")).alias("location"), F.lit("based in Salem, OR today").alias("posting_text"),
    )
    p = postings(rows)
    return p.select("record_id", "name", F.col("address.city").alias("city"), F.col("address.region").alias("state"), F.size("evidence").alias("n"), F.col("evidence")[0]["detail"].alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        signals_recent, signals_funded, first_events, last_events, filters_struct, knockouts, ranked_accounts, judge_queue, judge_batches, verdict_kept, verdict_rejected,
        judge_stats, deliver_topn, deliver_map, funnel, export_accounts, index_rows, excluded, seen_recent, er_edges, er_groups, er_torn_accounts, er_accounts, account_filters, all_searches, search_funnels, site_budget, site_read,
        enrich_counters, website_lookup, vendor_match, vendor_filter, award_dedup, top_buyers, other_vendors, by_company, listed_purchases, coverage_rollup, search_queries,
        source_union, tags_union, date_windows, latest_filing, largest_awards, account_view, early_prune, risks_coerced, decision_faults, conversation_postings,
    )
}

# ---------------------------------------------------------------- the same in SQL

_EV = f"ev AS (SELECT user_id, event_id, {KIND} AS kind, {DATE.replace('cast(ts as string)', 'cast(ts as varchar)')} AS date, concat(event_type, ' by ', user_id % 10) AS detail FROM events)"
_valid = "CASE WHEN regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(date AS DATE) END"
_DEC = f"""dec AS (SELECT doc_id, 'doc-' || doc_id AS account_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END AS decision, CASE WHEN doc_id % 4 = 0 THEN 'strong' WHEN doc_id % 4 = 1 THEN 'none' ELSE 'possible' END AS fit,
  greatest(1, least(5, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE doc_id % 9 END)) AS fit_score FROM labels),
  j AS (SELECT q.account_id, q.name, q.doc_id, row_number() OVER (ORDER BY q.source, q.qrank) AS rank, d.decision, d.fit, d.fit_score FROM queue q LEFT JOIN dec d USING (account_id)),
  kept AS (SELECT *, row_number() OVER (ORDER BY fit_score DESC, rank) AS place FROM j WHERE decision = 'keep' AND fit <> 'none')"""
_all = f"WITH {_ACC}, {_QUEUE}, {_DEC}"
_REC = f"""rec AS (SELECT page_id, 'web:' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS record_id, {DOMAIN} AS d, url, html FROM pages)"""
#: The ordered rule, edge by edge over one row: the label of each record and the domain of each label.
_ORDERED = f"""torn AS (SELECT page_id, record_id, CASE WHEN page_id % 3 <> 0 THEN d END AS d, CASE WHEN page_id % 3 <> 0 THEN url END AS site, CASE WHEN page_id % 2 = 0 THEN 'web_search' ELSE 'csv' END AS source,
  'Site ' || (page_id % 40) || CASE WHEN page_id % 2 = 0 THEN ', Inc.' ELSE '' END AS name, (page_id % 40) || CASE WHEN page_id % 5 = 0 THEN 'salem' ELSE '' END AS key, row_number() OVER (ORDER BY record_id) AS i FROM rec),
  ties AS (SELECT row_number() OVER (ORDER BY phase, b) AS k, a, b FROM (
    SELECT 1 AS phase, min(i) OVER (PARTITION BY d) AS a, i AS b FROM torn WHERE d IS NOT NULL UNION ALL SELECT 2, min(i) OVER (PARTITION BY key), i FROM torn) WHERE a <> b),
  walk AS (SELECT 0::BIGINT AS k, (SELECT list(i ORDER BY i) FROM torn) AS lab, (SELECT list(d ORDER BY i) FROM torn) AS own
    UNION ALL SELECT k, CASE WHEN fits THEN list_transform(lab, lambda x: CASE WHEN x = lb THEN la ELSE x END) ELSE lab END, CASE WHEN fits THEN list_transform(own, lambda x, j: CASE WHEN j = la THEN coalesce(own[la], own[lb]) ELSE x END) ELSE own END
    FROM (SELECT *, la <> lb AND coalesce(own[la] = own[lb], TRUE) AS fits FROM (SELECT ties.k, lab, own, lab[a] AS la, lab[b] AS lb FROM walk JOIN ties ON ties.k = walk.k + 1))),
  grouped AS (SELECT torn.*, lab[i] AS lab FROM torn, (SELECT lab FROM walk ORDER BY k DESC LIMIT 1))"""
_PUR = """pur AS (SELECT r_name AS buyer, CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 5 = 1 THEN lower(r_name) ELSE n_name END AS unit, s_name AS vendor, CASE WHEN s_suppkey % 4 = 0 THEN 's-' || s_suppkey END AS aid,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Listed ' || s_suppkey END AS listed, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN unit = '' OR lower(unit) = lower(buyer) THEN buyer ELSE buyer || ' / ' || unit END AS label
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _tail(items: str) -> str:
    return f"array_to_string(({items})[1:{{k}}], ', ') || CASE WHEN len({items}) > {{k}} THEN ' +' || (len({items}) - {{k}}) ELSE '' END"


ORACLE = {
    "signals_recent": f"""WITH {_EV}, s AS (SELECT user_id, event_id, 'recently_registered' AS kind, 'Registered ' || date || ' (' || (DATE '{RUN_DAY}' - d) || ' days ago)' AS detail FROM (SELECT *, {_valid} AS d FROM ev) WHERE kind = 'registered' AND DATE '{RUN_DAY}' - d BETWEEN 0 AND 9)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY f) - 1 AS pos, kind, detail FROM (SELECT user_id, kind, detail, min(event_id) AS f FROM s GROUP BY ALL)""",
    "signals_funded": f"""WITH {_EV}, s AS (SELECT user_id, event_id, kind, detail FROM (SELECT *, {_valid} AS d FROM ev) WHERE kind = 'hiring' OR (kind = 'funded' AND (date = '' OR DATE '{RUN_DAY}' - d <= 5)))
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY kind <> 'funded', f) - 1 AS pos, kind, detail FROM (SELECT user_id, kind, detail, min(event_id) AS f FROM s GROUP BY ALL)""",
    "first_events": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "last_events": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "filters_struct": f"WITH {_ACC} SELECT doc_id, in_region, relevant, no_exclude_terms, not_excluded, signal_ok FROM acc",
    "knockouts": f"WITH {_ACC} SELECT doc_id, passed, score FROM acc",
    "ranked_accounts": f"WITH {_ACC}, {_RANKED} SELECT doc_id, source, rank FROM ranked",
    "judge_queue": f"WITH {_ACC}, {_QUEUE} SELECT source, account_id, qrank AS rank FROM queue",
    "judge_batches": f"WITH {_ACC}, {_QUEUE}, r AS (SELECT doc_id, row_number() OVER (ORDER BY source, qrank) AS rank, count(*) OVER () AS n FROM queue) SELECT (rank - 1) // 20 + 1 AS part, CAST(ceil(n / 20.0) AS INT) AS parts, count(*) AS n, min(doc_id) AS lo FROM r GROUP BY r.n, part",
    "verdict_kept": f"""{_all} SELECT account_id, fit, fit_score, CASE WHEN doc_id % 2 = 0 THEN 'makes things' ELSE '{verdicts.NO_DESCRIPTION}' END AS what_they_do, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS cited,
        CASE WHEN doc_id % 5 = 0 THEN '{verdicts.NO_RISKS}' ELSE 'small' END AS risks, 'buyer' AS contact_role, CASE WHEN fit = 'strong' THEN 'hello' END AS draft FROM kept""",
    "verdict_rejected": f"""{_all} SELECT account_id, CASE WHEN decision IS NULL THEN '{verdicts.NO_DECISION}' WHEN doc_id % 3 = 0 THEN 'weak fit' ELSE '{verdicts.NO_REASON}' END AS reason FROM j WHERE account_id NOT IN (SELECT account_id FROM kept)
        UNION ALL SELECT account_id, '{verdicts.BELOW.format(10)}' FROM kept WHERE place > 10""",
    "judge_stats": f"""{_all} SELECT (SELECT coalesce(sum(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END), 0) FROM kept) AS uncited_points_removed, (SELECT count(*) FROM j WHERE decision IS NULL) AS missing_decisions,
        (SELECT count(*) FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE (doc_id * 2 + 1) % 3 = 0) WHERE 'doc-' || doc_id NOT IN (SELECT account_id FROM queue)) AS unknown_ids_ignored""",
    "deliver_topn": f"{_all} SELECT account_id, place, fit_score FROM kept WHERE place <= 25",
    "deliver_map": f"""{_all}, {_RANKED} SELECT r.account_id, row_number() OVER (ORDER BY k.fit IS NULL, k.fit_score DESC, r.source, r.rank) AS place FROM ranked r LEFT JOIN kept k USING (account_id)
        WHERE r.passed AND (k.account_id IS NOT NULL OR r.account_id NOT IN (SELECT account_id FROM queue))""",
    "funnel": f"WITH {_ACC} SELECT source, count(*) AS records, count(*) FILTER (relevant) AS relevant, count(*) FILTER (passed) AS passed FROM acc GROUP BY source",
    "export_accounts": f"WITH {_ACC}, {_RANKED} SELECT rank, account_id, name, 'documents; ' || source AS sources, coalesce(CAST(quality AS VARCHAR), '') AS fit, '$' || format('{{:,d}}', CAST(round_even(score * 1234.5, 0) AS BIGINT)) AS score FROM ranked WHERE passed",
    "index_rows": f"WITH {_ACC}, {_RANKED}, l AS (SELECT source, list(name ORDER BY rank) AS names FROM ranked WHERE passed GROUP BY source) SELECT source, {_tail('names').format(k=5)} AS cell FROM l",
    "excluded": "SELECT s_suppkey, s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS excluded FROM supplier",
    "seen_recent": r"""WITH days AS (SELECT CAST(ts AS DATE) AS day, max(user_id) AS k FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7), b AS (SELECT string_agg(lower(p_name), ' | ') AS blob FROM days JOIN part ON k = p_partkey)
        SELECT p_partkey, p_name <> '' AND regexp_matches(blob, '(^|[^a-z0-9])' || regexp_escape(lower(p_name)) || '($|[^a-z0-9])') AS seen FROM part, b""",
    "er_edges": f"""WITH {_REC}, k AS (SELECT record_id, 'd:' || d AS key FROM rec WHERE page_id % 3 <> 0 UNION ALL SELECT record_id, 'n:site ' || (page_id % 40) || chr(10) || CASE WHEN page_id % 5 = 0 THEN 'salem' ELSE '' END FROM rec)
        SELECT key, min(record_id) AS first, count(*) AS n FROM k GROUP BY key""",
    "er_groups": f"""WITH RECURSIVE {_REC}, {_ORDERED} SELECT record_id, (SELECT min(record_id) FROM grouped h WHERE h.lab = g.lab) AS group_id FROM grouped g""",
    "er_torn_accounts": f"""WITH RECURSIVE {_REC}, {_ORDERED},
        m AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY site IS NULL, record_id) AS ord FROM grouped)
        SELECT max(d) AS domain, first(name ORDER BY ord) AS name, first(site ORDER BY ord) FILTER (site IS NOT NULL) AS website, string_agg(record_id, ',' ORDER BY ord) AS record_ids,
        first(source ORDER BY ord) || CASE WHEN min(source) < max(source) THEN CASE first(source ORDER BY ord) WHEN 'csv' THEN ',web_search' ELSE ',csv' END ELSE '' END AS sources,
        max(page_id) FILTER (page_id % 7 = 0)::INT AS employees, CASE WHEN count(*) FILTER (page_id % 5 = 0) > 0 THEN 'Salem' END AS city FROM m GROUP BY lab""",
    "er_accounts": f"""WITH {_REC}, c AS (SELECT d, list(DISTINCT 'k' || (page_id % 3)) AS ks FROM rec GROUP BY d), o AS (SELECT d, k, min(page_id) AS f FROM (SELECT d, page_id, 'k' || (page_id % 3) AS k FROM rec) GROUP BY d, k)
        SELECT trim(regexp_replace(r.d, '[^a-z0-9]+', '-', 'g'), '-') AS account_id, r.d AS domain, 'Page ' || min(page_id) AS name, first(url ORDER BY page_id) AS website, first('+1 ' || page_id ORDER BY page_id) FILTER (page_id % 4 = 0) AS phone, max(page_id) FILTER (page_id % 7 = 0) AS employees,
        (SELECT string_agg(s, ',' ORDER BY f) FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'web_search' ELSE 'csv' END AS s, min(page_id) AS f FROM rec x WHERE x.d = r.d GROUP BY 1)) AS sources,
        split_part(r.d, '.', -1) || ',' || (SELECT string_agg(k, ',' ORDER BY f) FROM o WHERE o.d = r.d) AS categories, count(*) AS n, CASE WHEN count(*) FILTER (page_id % 5 = 0) > 0 THEN 'Salem' END AS city FROM rec r GROUP BY r.d""",
    "site_budget": f"WITH {_REC}, f AS (SELECT d, min(page_id) AS first_page FROM rec GROUP BY d ORDER BY first_page LIMIT 20) SELECT page_id, rec.d AS domain, f.d IS NOT NULL AS read FROM rec LEFT JOIN f ON rec.d = f.d",
    "site_read": f"""WITH {_REC}, t AS (SELECT page_id, d, left({_sql_text()}, 2500) AS t, row_number() OVER (PARTITION BY d ORDER BY page_id) AS r FROM rec) SELECT d AS domain, count(*) AS pages, md5(left(string_agg(t, chr(10) || chr(10) ORDER BY r), 6000)) AS digest FROM t WHERE r <= 3 GROUP BY d""",
    "enrich_counters": f"WITH {_REC} SELECT count(DISTINCT d) AS sites, count(*) FILTER (length({_sql_text()}) < 300) AS thin FROM rec",
    "website_lookup": f"""WITH {_REC}, w AS (SELECT unnest(regexp_extract_all(concat_ws(' ', replace(d, '-', ''), lower(t)), '[a-z]+')) AS word, page_id FROM (SELECT page_id, d, (SELECT 1) AS one, {{title}} AS t FROM rec)), n AS (SELECT doc_id, unnest(list_filter({sql_words('text')}, lambda w: length(w) >= 4 AND w NOT IN {{common}})) AS word FROM documents)
        SELECT doc_id, min(page_id) AS page_id FROM n JOIN w USING (word) GROUP BY doc_id""",
    "vendor_match": f"""WITH v AS (SELECT vendor, {TOKENS.replace("'name'", "'vendor'")} AS vt FROM (SELECT DISTINCT concat({COMPANY}, CASE p_partkey % 3 WHEN 0 THEN ' Holdings' ELSE '' END) AS vendor, vendor AS name FROM part)),
        c AS (SELECT account_id, pos, {TOKENS} AS ct FROM (SELECT 'c-' || p_partkey AS account_id, {COMPANY} AS name, p_partkey AS pos FROM part))
        SELECT vendor, account_id FROM v JOIN c ON len(ct) > 0 AND list_has_all(vt, ct) AND (len(list_filter(ct, lambda w: w NOT IN {{generic}})) > 0 OR len(ct) = len(vt)) QUALIFY row_number() OVER (PARTITION BY vendor ORDER BY len(ct) DESC, pos) = 1""",
    "vendor_filter": "SELECT o_orderkey AS award_id, c_name AS vendor, o_orderpriority AS description, o_totalprice AS amount, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders JOIN customer ON o_custkey = c_custkey WHERE (upper(o_orderpriority) LIKE '%URGENT%' OR upper(c_name) LIKE '%CUSTOMER%00%7') AND o_orderdate >= DATE '1998-01-01'",
    "award_dedup": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 2 END AS q FROM orders WHERE o_custkey % 3 = 0 OR o_totalprice > 200000",
    "top_buyers": f"WITH {_PUR} SELECT label, sum(amount) AS total, count(*) AS count, string_agg(DISTINCT coalesce(listed, vendor), '; ' ORDER BY coalesce(listed, vendor)) AS vendors FROM pur GROUP BY label",
    "other_vendors": f"WITH {_PUR} SELECT vendor, sum(amount) AS total, count(*) AS count, string_agg(DISTINCT label, '; ' ORDER BY label) AS buyers FROM pur WHERE aid IS NULL GROUP BY vendor",
    "by_company": f"WITH {_PUR}, p AS (SELECT aid, label, sum(amount) AS t, count(*) AS n FROM pur WHERE aid IS NOT NULL GROUP BY aid, label), l AS (SELECT aid, sum(t) AS total, sum(n) AS count, list(label ORDER BY t DESC, label) AS b FROM p GROUP BY aid) SELECT aid AS account_id, total, count, {_tail('b').format(k=3)} AS buyers FROM l",
    "listed_purchases": f"WITH {_PUR} SELECT coalesce(listed, '') AS listed_company, count(*) AS n, CAST(max(amount) AS DOUBLE) AS most FROM pur WHERE amount > 60000 GROUP BY 1",
    "coverage_rollup": "SELECT c_mktsegment AS naics, coalesce(sum(c_custkey % 50) FILTER (c_custkey % 4 = 0), 0) AS total, coalesce(sum(c_custkey % 50) FILTER (c_custkey % 4 IN (1, 2)), 0) AS under_20, min('Label ' || c_mktsegment) AS label FROM customer GROUP BY ROLLUP (c_mktsegment)",
    "search_queries": "SELECT lower(n_name) || ' valves ' || upper(left(r_name, 1)) || CASE WHEN contains(r_name, ' ') THEN lower(split_part(substr(r_name, 2), ' ', 1)) || ' ' || upper(left(split_part(r_name, ' ', 2), 1)) || lower(substr(split_part(r_name, ' ', 2), 2)) ELSE lower(substr(r_name, 2)) END AS query FROM nation, region WHERE n_nationkey % 2 = 0 UNION ALL SELECT lower(n_name) FROM nation WHERE n_nationkey % 2 = 1",
    "source_union": "SELECT 'supplier' AS source, count(*) AS records, count(s_nationkey) AS nations, 0 AS segments, 'ok' AS status FROM supplier UNION ALL SELECT 'customer', count(*), 0, count(c_mktsegment), 'ok' FROM customer",
    "tags_union": "WITH p AS (SELECT p_brand, list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS words FROM part GROUP BY p_brand), b AS (SELECT *, list_filter(['bolt', 'nothing', 'red'], lambda x: list_contains(words, x)) AS i, list_filter(['bolt', 'nothing', 'red'], lambda x: NOT list_contains(words, x)) AS m FROM p) SELECT p_brand, len(words) AS n, len(i) > 0 AS any, array_to_string(i, ',') AS both, array_to_string(m, ',') AS missing FROM b",
    "date_windows": "SELECT dayname(o_orderdate) AS weekday, count(*) AS n, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-01-01' - 730 GROUP BY 1",
    "latest_filing": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "largest_awards": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "account_view": "SELECT doc_id, md5(left(text, 3000)) AS digest, length(text) // 4 AS tokens FROM documents",
    "early_prune": "SELECT p_brand, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events JOIN part ON user_id = p_partkey WHERE event_type = 'purchase' AND value > 5 AND p_size < 25 GROUP BY p_brand",
    "risks_coerced": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN 'a; ' || quality ELSE '' END AS risks FROM labels",
    "decision_faults": """SELECT doc_id * 100000 AS pos, CASE WHEN doc_id % 7 = 3 THEN 'x' WHEN doc_id % 7 IN (0, 1, 6) THEN 'a-' || doc_id END AS account_id, CASE WHEN doc_id % 7 IN (0, 1, 6) THEN quality::INT END AS fit_score,
        CASE doc_id % 7 WHEN 1 THEN 'decision is none of keep, reject' WHEN 2 THEN 'no account_id; fit_score has another type; why_fit has another type' WHEN 3 THEN 'no decision; risks has another type' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'no list of decisions' ELSE '' END AS faults FROM labels""",
    "conversation_postings": """WITH c AS (SELECT conv_id % 40 AS k, conv_id * 1000 + turn AS pos, turn, role FROM conversations) SELECT 'postings:acme-' || k || '-llc' AS record_id, 'Acme ' || k || ' LLC' AS name, CASE WHEN first(turn ORDER BY pos) % 2 = 0 THEN 'Dayton' ELSE 'Salem' END AS city,
        CASE WHEN first(turn ORDER BY pos) % 2 = 0 THEN 'OH' ELSE 'OR' END AS state, count(*) AS n, 'Hiring: ' || first(role || ' ' || turn ORDER BY pos) AS first FROM c GROUP BY k""",
}
ORACLE["account_filters"] = f"""WITH {_REC}, o AS (SELECT d, k, min(page_id) AS f FROM (SELECT d, page_id, 'k' || (page_id % 3) AS k FROM rec) GROUP BY d, k),
  a AS (SELECT d, 'Page ' || min(page_id) AS name, 'Page ' || min(page_id) || chr(10) || split_part(d, '.', -1) || ' ' || (SELECT string_agg(k, ' ' ORDER BY f) FROM o WHERE o.d = r.d) AS t, max(page_id) FILTER (page_id % 7 = 0) AS n, count(DISTINCT page_id % 2) AS s FROM rec r GROUP BY d),
  b AS (SELECT *, trim(regexp_replace(d, '[^a-z0-9]+', '-', 'g'), '-') AS account_id, CASE WHEN regexp_matches(t, '(^|[^A-Za-z])Page [13]([^A-Za-z]|$)') THEN 'in' ELSE 'unknown' END AS region_status,
    list_filter([CASE WHEN regexp_matches(t, '(?i)page [0-9]+') THEN 'page [0-9]+' END, CASE WHEN regexp_matches(t, '(?i)\\bk1\\b') THEN '\\bk1\\b' END, CASE WHEN regexp_matches(t, '(?i)net') THEN 'net' END], lambda x: x IS NOT NULL) AS h,
    CASE WHEN n IS NULL THEN 'unknown' WHEN n < 20 THEN 'under 20' WHEN n < 100 THEN '20-99' WHEN n < 250 THEN '100-249' ELSE '250+' END AS size_band, NOT regexp_matches(t, '(?i)page 11') AS no_exclude_terms, d <> 'spam-farm.example.org' AS not_excluded FROM a),
  c AS (SELECT *, len(h) > 0 AS relevant, region_status = 'in' AND relevant AND no_exclude_terms AND not_excluded AS passed,
    least(len(h), 5) + (s > 1)::INT + (region_status = 'in')::INT + CASE size_band WHEN 'under 20' THEN 4 WHEN '20-99' THEN 3 WHEN '100-249' THEN 1 ELSE 0 END AS score FROM b)
  SELECT account_id, region_status, array_to_string(h, ',') AS hits, size_band, relevant, no_exclude_terms, not_excluded, passed, score, row_number() OVER (ORDER BY passed DESC, score DESC, lower(name), account_id) AS rank FROM c"""
_one = lambda name, region, hits, bad, gone, strict, small: f"""SELECT '{name}' AS search, *, len(h) > 0 OR {not hits} AS relevant FROM (SELECT *, {region} AS region_status,
    list_filter(CAST([{', '.join(chr(39) + x + chr(39) for x in hits)}] AS VARCHAR[]), lambda x: regexp_matches(t, '(?i)' || x)) AS h, {bad} AS no_exclude_terms, {gone} AS not_excluded, {strict} AS strict, {small} AS small FROM a)"""  # noqa: E731
_EACH = f"""{_REC}, o AS (SELECT d, k, min(page_id) AS f FROM (SELECT d, page_id, 'k' || (page_id % 3) AS k FROM rec) GROUP BY d, k),
  a AS (SELECT d, trim(regexp_replace(d, '[^a-z0-9]+', '-', 'g'), '-') AS account_id, 'Page ' || min(page_id) AS name, 'Page ' || min(page_id) || chr(10) || split_part(d, '.', -1) || ' ' || (SELECT string_agg(k, ' ' ORDER BY f) FROM o WHERE o.d = r.d) AS t, max(page_id) FILTER (page_id % 7 = 0) AS n, count(DISTINCT page_id % 2) AS s FROM rec r GROUP BY d),
  e AS ({_one("pages", "CASE WHEN regexp_matches(t, '(^|[^A-Za-z])Page [13]([^A-Za-z]|$)') THEN 'in' ELSE 'unknown' END", PAGES_POLICY.include_any, "NOT regexp_matches(t, '(?i)page 11')", "d <> 'spam-farm.example.org'", True, True)}
    UNION ALL {_one("sevens", "CASE WHEN regexp_matches(t, '(^|[^A-Za-z])Page 7([^A-Za-z]|$)') THEN 'in' ELSE 'unknown' END", ["page [0-9]*7"], "NOT regexp_matches(t, '(?i)page 27') AND NOT regexp_matches(t, '(?i)[[:<:]]k2[[:>:]]')".replace("[[:<:]]", chr(92) + "b").replace("[[:>:]]", chr(92) + "b"), "name <> 'Page 17'", False, False)}
    UNION ALL {_one("all", "'unknown'", [], "TRUE", "TRUE", False, True)}),
  p AS (SELECT *, CASE search WHEN 'all' THEN TRUE ELSE (region_status = 'in' OR NOT strict) AND relevant AND no_exclude_terms AND not_excluded END AS passed,
    least(len(h), 5) + (s > 1)::INT + (region_status = 'in')::INT + CASE WHEN NOT small OR n IS NULL OR n >= 250 THEN 0 WHEN n < 20 THEN 4 WHEN n < 100 THEN 3 ELSE 1 END AS score FROM e)"""
ORACLE["all_searches"] = f"""WITH {_EACH} SELECT search, account_id, region_status, array_to_string(h, ',') AS hits, relevant, no_exclude_terms, not_excluded, passed, score,
  row_number() OVER (PARTITION BY search ORDER BY passed DESC, score DESC, lower(name), account_id) AS rank FROM p"""
ORACLE["search_funnels"] = f"""WITH {_EACH} SELECT search, count(*) AS accounts, count(*) FILTER (region_status = 'in' OR NOT strict) AS in_region, count(*) FILTER (relevant) AS relevant, count(*) FILTER (no_exclude_terms) AS no_exclude_terms,
  count(*) FILTER (not_excluded) AS not_excluded, count(*) FILTER (passed) AS passed, max(score) AS best FROM p GROUP BY search"""
_title = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
ORACLE["website_lookup"] = ORACLE["website_lookup"].replace("{title}", f"trim({sql_decoded(_title)})").replace("{common}", sql_list(T.COMMON_NAME_WORDS))
ORACLE["vendor_match"] = ORACLE["vendor_match"].replace("{generic}", sql_list(T.GENERIC_WORDS))
