"""Purchase records matched to listed companies, and who buys from whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def match_vendors(vendors: DataFrame, companies: DataFrame) -> DataFrame:
    """(vendor, account_id) for vendors whose name holds every word of a company's.

    vendors: vendor; companies: account_id, name, pos. A relational division on words: joined on
    equal words and counted. A name of generic words alone must be the whole vendor name. Of
    several companies the one with most words wins, then the first; so of companies with the same words
    only the first is looked for. One is looked up by its rarest word among vendors, so a frequent one
    ("supply") doesn't bring every vendor together with it; one of generic words by all of its words.
    """
    v = vendors.select("vendor").distinct().withColumn("vt", T.name_tokens("vendor"))
    words = companies.select("account_id", "pos", F.array_sort(T.name_tokens("name")).alias("ct")).filter(F.size("ct") > 0)
    c = words.groupBy("ct").agg(F.min_by("account_id", F.struct("pos", "account_id")).alias("account_id"), F.min("pos").alias("pos"))
    telling = F.exists("ct", lambda w: ~w.isin(T.GENERIC_WORDS))
    v_words = v.select("vendor", F.explode("vt").alias("word"), "vt")
    often = v_words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    c_words = c.filter(telling).select("account_id", "pos", "ct", F.explode("ct").alias("word")).join(often, "word", "left")
    rarest = c_words.groupBy("account_id", "pos").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"), F.first("ct").alias("ct"))
    held = v_words.join(rarest, "word").filter(F.size(F.array_except("ct", "vt")) == 0)
    whole = v.withColumn("ct", F.array_sort("vt")).join(c.filter(~telling), "ct")
    hits = held.select("vendor", "account_id", "pos", "ct").unionByName(whole.select("vendor", "account_id", "pos", "ct"))
    best = Window.partitionBy("vendor").orderBy(F.desc(F.size("ct")), "pos")
    return hits.withColumn("r", F.row_number().over(best)).filter("r = 1").select("vendor", "account_id")


def buyer_label(buyer: Column, unit: Column) -> Column:
    u = F.trim(F.coalesce(unit, F.lit("")))
    return F.when((u == "") | (F.lower(u) == F.lower(buyer)), buyer).otherwise(F.concat(buyer, F.lit(" / "), u))


def _money(c: str) -> Column:
    return F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,2)")).cast("decimal(18,2)")


def labelled(purchases: DataFrame, companies: DataFrame) -> DataFrame:
    """Purchases with the buyer's label and the listed name of a matched vendor. companies: a search's list."""
    names = companies.select(F.col("account_id").alias("vendor_account_id"), F.col("name").alias("listed_company"))
    return purchases.join(names, "vendor_account_id", "left").withColumn("label", buyer_label(F.col("buyer"), F.col("buyer_unit")))


def own_lookups(purchases: DataFrame) -> DataFrame:
    """Purchases (with vendor_account_id) without what a company's lookup found of other companies.

    purpose: "market", or the account a lookup was for; a table without that column is a market's alone. A search by
    name is loose, so a lookup keeps only purchases whose vendor is that very company.
    """
    if "purpose" not in purchases.columns:
        return purchases
    mine = F.col("vendor_account_id").eqNullSafe(F.col("purpose"))
    return purchases.filter(F.col("purpose").isNull() | (F.col("purpose") == "market") | mine)


def totals_with_list(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Of each key its total, its count and all its different values in order (`name`).

    Rows are added up by key and value first, so what a key gathers is its result row alone.
    """
    pairs = rows.withColumn("_v", value).groupBy(key, "_v").agg(_money("amount").alias("t"), F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(F.sum("t").cast("decimal(18,2)").alias("total"), F.sum("n").alias("count"), F.array_sort(F.collect_list("_v")).alias(name))


def by_company(rows: DataFrame) -> DataFrame:
    """Of each listed company its total, count and buyers, the largest first; a company sells to its own buyers only, so that list is short."""
    per = rows.filter("vendor_account_id is not null").groupBy("vendor_account_id", "listed_company", "label").agg(_money("amount").alias("t"), F.count(F.lit(1)).alias("n"))
    buyers = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("m"), "label"))), lambda x: x["label"])
    return per.groupBy("vendor_account_id", "listed_company").agg(F.sum("t").cast("decimal(18,2)").alias("total"), F.sum("n").alias("count"), buyers.alias("buyers"))


def top_buyers(rows: DataFrame) -> DataFrame:
    return totals_with_list(rows, "label", F.coalesce("listed_company", "vendor"), "vendors")


def other_vendors(rows: DataFrame) -> DataFrame:
    return totals_with_list(rows.filter("vendor_account_id is null"), "vendor", F.col("label"), "buyers")


def coverage(rows: DataFrame) -> DataFrame:
    """Census rows (naics, label, size_label, establishments) to totals and places under 20 employees, by code and over all (null)."""
    bound = T.label_bound("size_label")
    n = F.col("establishments")
    return rows.rollup("naics").agg(
        F.coalesce(F.sum(F.when(bound.isNull(), n)), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(bound < 20, n)), F.lit(0)).alias("under_20"), F.min("label").alias("label")
    )
