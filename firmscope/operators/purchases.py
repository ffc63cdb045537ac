"""Purchase records of a search: what to ask for, and which of the answers to keep.

A search asks one market query and a lookup for each listed company. All queries and their
answers are one table; a query's purpose ("market", or the company's account) stays with each
award found. A lookup by name is loose, so vendors are matched first, a lookup keeps what its own company
sold, and only then does an award that several queries found count for the first of them.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.listings import award_rows
from ..sources.records import first_wins
from .buyers import match_vendors, own_lookups

# What the federal award search is asked for, and the export's columns in order.
CONTRACT_TYPES = ["A", "B", "C", "D"]
AWARD_FIELDS = ["Award ID", "Recipient Name", "Awarding Agency", "Awarding Sub Agency", "Award Amount", "Description", "Start Date", "generated_internal_id"]
PURCHASE_COLUMNS = ["source", "buyer", "buyer_unit", "vendor", "listed_company", "description", "amount", "date", "award_id", "url"]

PAGE_ROWS = 100


class PurchaseError(ValueError):
    """A purchase source that can't be asked."""


def _texts(values: list[Any]) -> Column:
    return F.array(*[F.lit(str(v)) for v in values])


def award_queries(companies: DataFrame, today: str, years: int = 5, naics: list[Any] | None = None, states: list[str] | None = None, keywords: list[str] | None = None, by_company: bool = True, most: int = 200) -> DataFrame:
    """companies: account_id, name, pos (from 0). Rows qpos, purpose and body, the first page's request as JSON.

    The market is asked for first, if anything describes it. A company whose name has no telling word isn't looked up.
    """
    start = F.date_format(F.date_sub(F.lit(today).cast("date"), 365 * years), "yyyy-MM-dd")
    base = [_texts(CONTRACT_TYPES).alias("award_type_codes"), F.array(F.struct(start.alias("start_date"), F.lit(today).alias("end_date"))).alias("time_period")]

    def body(*own: Column) -> Column:
        asked = F.struct(F.struct(*base, *own).alias("filters"), F.lit(min(PAGE_ROWS, most)).alias("limit"), F.lit(1).alias("page"), F.lit("Award Amount").alias("sort"), F.lit("desc").alias("order"), _texts(AWARD_FIELDS).alias("fields"))
        return F.to_json(asked).alias("body")

    market = []
    if naics:
        market.append(F.struct(_texts(naics).alias("require")).alias("naics_codes"))
    if states:
        market.append(F.array(*[F.struct(F.lit("USA").alias("country"), F.lit(s).alias("state")) for s in states]).alias("place_of_performance_locations"))
    if keywords:
        market.append(_texts(keywords).alias("keywords"))
    rows = companies.sparkSession.range(1 if market else 0).select(F.lit(0).cast("long").alias("qpos"), F.lit("market").alias("purpose"), body(*market))
    if by_company:
        words = F.replace(F.trim(F.replace(T.vendor_pattern("name"), F.lit("%"), F.lit(" "))), F.lit("%"), F.lit(" "))
        named = companies.select((F.col("pos") + 1).cast("long").alias("qpos"), F.col("account_id").alias("purpose"), "name", words.alias("words")).filter("words <> ''")
        rows = rows.unionAll(named.select("qpos", "purpose", body(F.array("words").alias("recipient_search_text"))))
    return rows


_HOST, _SET, _NAME = r"[a-z0-9-]+(\.[a-z0-9-]+)+", r"[a-z0-9]{4}-[a-z0-9]{4}", r"[a-z_][a-z0-9_]*"
#: What a city's source must and may name, and the form of each.
RULES = [
    (("domain",), True, _HOST), (("dataset",), True, _SET), (("fields", "vendor"), True, _NAME), (("fields", "description"), True, _NAME), (("fields", "amount"), True, _NAME),
    (("fields", "unit"), False, _NAME), (("fields", "date"), False, _NAME), (("fields", "id"), False, _NAME),
]


def checked_city(spec: dict[str, Any]) -> dict[str, Any]:
    """The source itself; names that could change the query's meaning raise a PurchaseError that lists all of them."""
    bad = []
    for path, needed, form in RULES:
        value: Any = spec
        for step in path:
            value = (value or {}).get(step) if isinstance(value, dict) else None
        if (value or needed) and not (isinstance(value, str) and re.fullmatch(form, value)):
            bad.append(".".join(path))
    if bad:
        raise PurchaseError(f"not plain names in a city's source: {', '.join(bad)}")
    return spec


def city_query(companies: DataFrame, spec: dict[str, Any], keywords: list[str], since: str) -> DataFrame:
    """One row url, where, order, limit: a city's table asked for any keyword in the description or any company in the vendor.

    Companies are a search's list. Without a word to ask for, running the plan fails.
    """
    fields = checked_city(spec)["fields"]
    like = lambda c, p: F.concat(F.lit(f"upper({c}) like '"), F.replace(p, F.lit("'"), F.lit("''")), F.lit("'"))
    words = F.filter(F.transform(F.array(*[F.lit(k) for k in keywords]).cast("array<string>"), T.like_literal), lambda k: k != "")
    asked = F.transform(words, lambda k: like(fields["description"], F.concat(F.lit("%"), k, F.lit("%"))))
    patterns = companies.select(T.vendor_pattern("name").alias("p")).filter("p <> ''").agg(F.array_sort(F.collect_set("p")).alias("patterns"))
    terms = F.concat(asked, F.transform("patterns", lambda p: like(fields["vendor"], p)))
    where = F.concat(F.lit("("), F.array_join(terms, " OR "), F.lit(")"), F.lit(f" AND {fields['date']} >= '{since}T00:00:00'" if fields.get("date") else ""))
    where = F.when(F.size(terms) == 0, F.raise_error(F.lit("a city's source needs keywords or companies to ask for"))).otherwise(where)
    order = F.lit(f"{fields['date']} DESC" if fields.get("date") else None).cast("string")
    return patterns.select(F.lit(f"https://{spec['domain']}/resource/{spec['dataset']}.json").alias("url"), where.alias("where"), order.alias("order"), F.lit(int(spec.get("max_rows", 1000))).alias("limit"))


def city_rows(rows: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """A city's answer (its own columns) as purchases: rows without a vendor go, amounts that aren't numbers are 0."""
    fields, have = checked_city(spec)["fields"], set(rows.columns)
    get = lambda k: F.coalesce(F.col(fields[k]).cast("string") if fields.get(k) in have else F.lit(None).cast("string"), F.lit(""))
    vendor = F.trim(get("vendor"))
    return rows.filter(vendor != "").select(
        F.lit("socrata").alias("source"), F.lit(spec.get("buyer") or spec["domain"]).alias("buyer"), get("unit").alias("buyer_unit"), vendor.alias("vendor"), F.left(get("description"), F.lit(300)).alias("description"),
        F.coalesce(get("amount").try_cast("double"), F.lit(0.0)).alias("amount"), F.left(get("date"), F.lit(10)).alias("date"), get("id").alias("award_id"), F.lit(f"https://{spec['domain']}/d/{spec['dataset']}").alias("url"),
    )


def kept_awards(pages: DataFrame, companies: DataFrame, most: int) -> DataFrame:
    """pages: purpose, qpos, page, payload; companies: account_id, name, pos. Each award once, with vendor_account_id, for the first query that may keep it."""
    found = award_rows(pages, most)
    matched = found.join(match_vendors(found, companies).withColumnRenamed("account_id", "vendor_account_id"), "vendor", "left")
    return first_wins(own_lookups(matched), ["key"], [F.col("qpos"), F.col("nth")])


def purchase_export(rows: DataFrame) -> DataFrame:
    """Purchases, the dearest first, as the export's columns; those that a table lacks are empty."""
    have = set(rows.columns)
    amount = F.col("amount").cast("double") if "amount" in have else F.lit(None).cast("double")
    ordered = rows.orderBy(amount.desc_nulls_last(), "vendor")
    return ordered.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in PURCHASE_COLUMNS])

