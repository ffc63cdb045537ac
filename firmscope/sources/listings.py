"""Readers of search results, certification pages, awards and census tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..operators.domains import without_listed
from ..operators.staging import staged
from .records import evidence, first_wins, record


def search_results(payloads: DataFrame, provider: str) -> DataFrame:
    """payloads: seq, query, payload. Both providers' answers as seq, query, title, url, snippet."""
    if provider not in ("brave", "tavily"):
        raise ValueError(f"unknown provider {provider}")
    inner, text = ("web", "description") if provider == "brave" else (None, "content")
    item = f"array<struct<title:string,url:string,{text}:string>>"
    shape = f"struct<web:struct<results:{item}>>" if inner else f"struct<results:{item}>"
    found = F.from_json("payload", shape)
    rows = payloads.select("seq", "query", F.posexplode((found["web"] if inner else found)["results"]).alias("at", "r"))
    return rows.select((F.col("seq") * 1000 + F.col("at")).alias("seq"), "query", F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.url").alias("url"), F.coalesce(F.col(f"r.{text}"), F.lit("")).alias("snippet"))


def web_search(results: DataFrame, skip: list[str] | None = None, listed: DataFrame | None = None) -> DataFrame:
    """One record a domain: the first result names it, all are evidence; directories are passed over, and what a list of domains (of any length) holds."""
    r = results.withColumn("domain", W.domain_of("url")).filter(F.col("domain").isNotNull() & ~W.is_skipped("domain", skip))
    r = without_listed(r, listed) if listed is not None else r
    seen = evidence("search_result", F.concat(F.lit('"'), "query", F.lit('"')), F.col("url"), snippet=F.col("snippet"))
    one = r.groupBy("domain").agg(F.min_by("title", "seq").alias("title"), F.array_sort(F.collect_list(F.struct("seq", seen.alias("e")))).alias("all"))
    return one.select(*record("web_search", F.col("domain"), T.title_name("title", F.col("domain")), website=F.concat(F.lit("https://"), "domain", F.lit("/")), evidence=F.col("all.e")))


def queries_for(templates: DataFrame, places: DataFrame) -> DataFrame:
    """templates: template; places: place. A template with {place} is asked of each place, another once."""
    with_place = templates.filter(F.contains("template", F.lit("{place}"))).crossJoin(F.broadcast(places))  # places come from one search's settings
    asked = with_place.select(F.trim(F.replace("template", F.lit("{place}"), F.col("place"))).alias("query"))
    return asked.unionAll(templates.filter(~F.contains("template", F.lit("{place}"))).select(F.trim("template").alias("query")))


def _plain(fragment: Column) -> Column:
    bare = W.decoded(F.regexp_replace(fragment, "<[^>]+>", " "))
    return T.collapse(F.regexp_replace(bare, r"\[[A-Z0-9]{1,2}\]", ""))


# Headings of a listing that aren't product types.
HEADER_WORDS = ["Trade Designation", "Size", "Temp", "Material", "Water", "Contact"]


def nsf(pages: DataFrame, label: str | Column, match: list[str] | None = None) -> DataFrame:
    """pages: pos, url, html of certification listings; label: what they certify, one for all or by page. One record a facility; a record seen again adds categories and evidence."""
    blocks = pages.select("pos", "url", (F.lit(label) if isinstance(label, str) else label).alias("label"), F.posexplode(F.split("html", r"(?i)<hr noshade>\s*<br>\s*<table")).alias("at", "block")).filter("at > 0")
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    b = blocks.withColumn("name", _plain(F.regexp_extract("block", r"(?is)<font size='\+2'>(.*?)</font>", 1))).filter("name <> ''")
    head = F.when(F.contains("block", F.lit("</table>")), F.substring_index("block", "</table>", 1)).otherwise(F.col("block"))
    lines = F.filter(F.transform(every(head, r"""(?is)<td align=['"]?left['"]?[^>]*>(.*?)</td>"""), _plain), lambda t: (t != "") & (t != F.col("name")))
    csz, phone = r"^(.+?),\s*([A-Z]{2})\s+([0-9]{5})(?:-?[0-9]{4})?$", r"^\+?[0-9\s().-]{7,}$"
    b = b.withColumns({"lines": lines, "site": F.nullif(F.regexp_extract(head, r"""(?i)<a href="([^"]+)"[^>]*>\s*Visit this company""", 1), F.lit(""))})
    town = F.try_element_at(F.filter("lines", lambda t: t.rlike(csz)), F.lit(-1))
    before = F.when(F.exists("lines", lambda t: t.rlike(csz)), F.slice("lines", F.lit(1), F.array_position("lines", F.get(F.filter("lines", lambda t: t.rlike(csz)), F.lit(0))).cast("int") - 1)).otherwise(F.col("lines"))
    street = F.get(F.filter(before, lambda t: ~t.rlike(phone) & ~t.isin("United States", "Visit this company's website")), F.lit(0))
    groups = F.transform(every(F.col("block"), r"""(?is)<font size="3">\s*<strong>(.*?)</strong>"""), _plain)
    types = F.array_sort(F.array_except(F.array_distinct(F.transform(every(F.col("block"), r"""(?is)colspan="[0-9]+">\s*(?:<br>)?\s*<font size="2">\s*<strong>(.*?)</strong>"""), _plain)), F.array(*[F.lit(w) for w in HEADER_WORDS])))
    places = F.array_sort(F.array_distinct(F.transform(every(F.col("block"), r"(?i)Facility\s*:\s*</strong>\s*([^<]+)"), _plain)))
    b = b.select(
        "pos", "at", "url", "label", "name", "site", street.alias("street"), F.regexp_extract(town, csz, 1).alias("city"), F.regexp_extract(town, csz, 2).alias("state"), F.regexp_extract(town, csz, 3).alias("zip"),
        F.try_element_at(F.filter("lines", lambda t: t.rlike(phone)), F.lit(-1)).alias("phone"), groups.alias("groups"), types.alias("types"), F.posexplode_outer(places).alias("n", "facility"),
    )
    cut = F.regexp_extract("facility", r"^(.*), ([^,]*)$", 1), F.regexp_extract("facility", r"^(.*), ([^,]*)$", 2)
    f_city, f_state = F.coalesce(cut[0], F.lit("")), F.when(F.contains("facility", F.lit(", ")), cut[1]).otherwise(F.coalesce("facility", F.lit("")))
    same = F.coalesce((F.lower(f_city) == F.lower("city")) & (f_state == F.col("state")), F.lit(False))
    made = F.when(F.size("types") > 0, F.array_join("types", "; ")).otherwise(F.array_join("groups", "; "))
    office = F.when(~same & (F.coalesce("city", F.lit("")) != ""), F.concat(F.lit(" | Company office: "), "city", F.lit(", "), "state")).otherwise(F.lit(""))
    seen = evidence("certification", F.concat("label", F.lit(": plant in "), F.coalesce("facility", F.lit("unlisted location"))), F.col("url"))
    seen = seen.withField("snippet", F.concat(F.left(F.concat(F.lit("Certified products: "), made), F.lit(300)), office))
    ident = F.concat(T.slug("name"), F.lit(":"), T.slug(F.coalesce("facility", F.lit("none"))))
    rows = b.select("pos", "at", *record(
        "nsf", ident, F.col("name"), website=F.col("site"), street=F.when(same, F.col("street")), city=F.coalesce(F.nullif(f_city, F.lit("")), F.col("city")),
        region=F.coalesce(F.nullif(f_state, F.lit("")), F.col("state")), postal=F.when(same, F.col("zip")), country=F.lit("US"), phone=F.col("phone"),
        categories=F.concat("groups", "types"), evidence=F.array(seen),
    ))
    if match:
        rows = rows.filter(F.size(T.pattern_hits(F.concat_ws(" ", "name", F.array_join("categories", " ")), match)) > 0)
    order = F.struct("pos", "at")
    rest = [c for c in rows.columns if c not in ("record_id", "categories", "evidence", "pos", "at")]
    merged = rows.groupBy("record_id").agg(
        *[F.min_by(c, order).alias(c) for c in rest], F.array_sort(F.collect_list(F.struct("pos", "at", "categories", "evidence"))).alias("all")
    )
    return merged.withColumns({"categories": F.array_distinct(F.flatten("all.categories")), "evidence": F.flatten("all.evidence")}).drop("all").select("record_id", *rest[:6], "categories", "evidence", *rest[6:])


AWARDS = """struct<results:array<struct<`Recipient Name`:string,`Awarding Agency`:string,`Awarding Sub Agency`:string,`Award Amount`:double,
  `Description`:string,`Start Date`:string,`Award ID`:string,generated_internal_id:string>>,page_metadata:struct<hasNext:boolean>,detail:string>"""


#: Pages of a query whose answers are put in order together.
PAGE_BLOCK = 64


def award_rows(pages: DataFrame, most: int) -> DataFrame:
    """pages: purpose, qpos, page, payload. All awards that each query found, its first `most` of them, in order (nth).

    An answer with an error fails the plan with its words. A query's pages end with the first that says so or holds nothing.
    Pages are taken in blocks of PAGE_BLOCK; what stands before a block comes from a table of blocks, so no task holds a query's answers.
    """
    from pyspark.sql import Window

    answer = F.from_json("payload", AWARDS)
    error = F.raise_error(F.concat(F.lit("the award service answered: "), answer["detail"]))
    found = F.when(F.coalesce(answer["detail"], F.lit("")) != "", error).otherwise(F.coalesce(answer["results"], F.array()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # a struct, so that a query or page without a number meets its like
    block = F.struct("qpos", F.floor(F.col("page") / PAGE_BLOCK).alias("nth"))
    shown = pages.select("purpose", "qpos", "page", found.alias("r"), F.coalesce(answer["page_metadata"]["hasNext"], F.lit(True)).alias("more"), block.alias("block"))
    # the answers are parsed once: they are read again for the blocks, the awards and their vendors
    shown = staged(shown.withColumns({"n": F.size("r"), "more": F.col("more") & (F.size("r") > 0)}), "award-pages")
    blocks, earlier = shown.groupBy("block").agg(F.sum("n").alias("n"), F.min("more").alias("more")), before(Window.partitionBy("block.qpos").orderBy("block.nth"))
    starts = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.coalesce(F.min("more").over(earlier), F.lit(True)).alias("open"))
    inside = before(Window.partitionBy("block").orderBy("page"))
    shown = shown.join(starts, "block").select(
        "purpose", "qpos", "r", (F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"), (F.col("open") & F.coalesce(F.min("more").over(inside), F.lit(True))).alias("on")
    )
    rows = shown.filter("on").select("purpose", "qpos", "start", F.posexplode("r").alias("at", "r")).withColumn("nth", F.col("start") + F.col("at") + 1).filter(F.col("nth") <= most)
    ident = F.nullif("r.generated_internal_id", F.lit(""))
    blank = lambda c, other="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return rows.select(
        "purpose", "qpos", "nth", F.coalesce(ident, F.col("r.`Award ID`")).alias("key"), F.lit("usaspending").alias("source"), blank("r.`Awarding Agency`", "Unknown federal agency").alias("buyer"), blank("r.`Awarding Sub Agency`").alias("buyer_unit"),
        blank("r.`Recipient Name`").alias("vendor"), F.left(blank("r.Description"), F.lit(300)).alias("description"), F.col("r.`Award Amount`").alias("amount"), F.col("r.`Start Date`").alias("date"), F.col("r.`Award ID`").alias("award_id"),
        F.when(ident.isNotNull(), F.concat(F.lit("https://www.usaspending.gov/award/"), ident)).otherwise("").alias("url"),
    )


def awards(pages: DataFrame, most: int) -> DataFrame:
    """Each query's first `most` awards, each once, for the earlier query; for a search that looks no companies up (else operators.purchases.kept_awards)."""
    return first_wins(award_rows(pages, most), ["key"], [F.col("qpos"), F.col("nth")])


def city_purchases(rows: DataFrame, fields: dict[str, str], keywords: list[str], companies: list[str], since: str, most: int | None = None) -> DataFrame:
    """A city's purchase table, filtered as its API would: any keyword in the description or any company pattern in the vendor, on or after a day; the newest `most`, if that is given."""
    text, vendor = F.upper(F.col(fields["description"])), F.upper(F.col(fields["vendor"]))
    asked = F.lit(False)
    for k in keywords:
        asked = asked | text.like(f"%{k.upper()}%")
    for p in companies:
        if p:
            asked = asked | vendor.like(p)
    day = F.left(F.col(fields["date"]).cast("string"), F.lit(10))
    found = rows.filter(asked & (day >= since) & (F.coalesce(F.trim(F.col(fields["vendor"])), F.lit("")) != ""))
    found = found.orderBy(day.desc(), F.col(fields["id"])).limit(most) if most else found
    return found.select(
        F.col(fields["id"]).alias("award_id"), F.col(fields["vendor"]).alias("vendor"), F.col(fields["description"]).alias("description"),
        F.coalesce(F.col(fields["amount"]).cast("string").try_cast("double"), F.lit(0.0)).alias("amount"), day.alias("date"),
    )


def census_rows(payloads: DataFrame) -> DataFrame:
    """payloads: payload, an array of arrays with its header first; rows naics, label, size_label, establishments."""
    table = payloads.select(F.from_json("payload", "array<array<string>>").alias("t")).filter(F.size("t") > 1)
    rows = table.select(F.col("t")[0].alias("head"), F.explode(F.slice("t", F.lit(2), F.size("t"))).alias("row"))
    get = lambda n: F.try_element_at("row", F.array_position("head", F.lit(n)).cast("int"))
    return rows.select(get("NAICS2017").alias("naics"), get("NAICS2017_LABEL").alias("label"), get("EMPSZES_LABEL").alias("size_label"), F.coalesce(get("ESTAB").try_cast("int"), F.lit(0)).alias("establishments"))
