"""Long lists of domains: what is on one, or lies under one of its entries.

A short list is a few literals (`functions.web.is_skipped`). A long one is a table: each distinct domain is looked up
with all domains above it by an equi-join, so a list of any length costs a join and not a test a row and entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web as W


def listed_among(domains: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct domains (column domain) that the list (column domain; any spelling of an address) holds or that lie under an entry, with the `entry` nearest to them."""
    entries = listed.select(W.domain_of("domain").alias("entry")).filter("entry is not null").distinct()
    above = domains.select("domain").distinct().select("domain", F.posexplode(W.domain_suffixes("domain")).alias("up", "entry"))
    return above.join(entries, "entry").groupBy("domain").agg(F.min_by("entry", "up").alias("entry"))


def without_listed(rows: DataFrame, listed: DataFrame, column: str = "domain") -> DataFrame:
    """Rows whose domain isn't listed; those without a domain stay."""
    gone = listed_among(rows.select(F.col(column).alias("domain")), listed).select(F.col("domain").alias(column))
    return rows.join(gone, column, "left_anti").select(*rows.columns)
