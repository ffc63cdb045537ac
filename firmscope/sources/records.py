"""The one shape of a company as a source saw it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

EVIDENCE = "array<struct<kind:string,detail:string,url:string,date:string,snippet:string>>"
#: Null: never read; error set: tried and failed; tech null: read without looking for tools.
SITE = "struct<url:string,title:string,description:string,text:string,error:string,pages:array<string>,tech:array<string>,scripts_scanned:int,client_rendered:boolean>"
RECORD = f"""record_id string, source string, name string, legal_name string, website string,
  address struct<street:string,city:string,region:string,postal_code:string,country:string>, phone string,
  categories array<string>, evidence {EVIDENCE}, coords struct<lat:double,lon:double>, employees int"""


def blank(x: Column | None) -> Column:
    """Empty text as null."""
    return F.lit(None).cast("string") if x is None else F.nullif(x.cast("string"), F.lit(""))


def evidence(kind: str, detail: Column, url: Column | None = None, date: Column | None = None, snippet: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), (none if url is None else url).alias("url"),
        (none if date is None else date).alias("date"), (none if snippet is None else F.left(snippet, F.lit(300))).alias("snippet"),
    )


def record(source: str, source_id: Column, name: Column, *, website=None, street=None, city=None, region=None, postal=None, country=None, phone=None, categories=None, evidence=None, legal_name=None, lat=None, lon=None, employees=None) -> list[Column]:
    """The columns of RECORD from a source's columns: cased names, state codes, short postal codes, no empty texts."""
    shown = lambda x: F.when(blank(x).isNotNull(), T.display_name(x)) if x is not None else blank(None)
    address = F.struct(
        blank(street).alias("street"), shown(city).alias("city"), (T.region_code(region) if region is not None else blank(None)).alias("region"),
        (blank(F.left(postal, F.lit(5))) if postal is not None else blank(None)).alias("postal_code"), (F.upper(blank(country)) if country is not None else blank(None)).alias("country"),
    )
    place = F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))) if lat is not None else F.lit(None).cast("struct<lat:double,lon:double>")
    cats = F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "") if categories is not None else F.array().cast("array<string>")
    seen = evidence.cast(EVIDENCE) if evidence is not None else F.array().cast(EVIDENCE)
    return [
        F.concat(F.lit(source + ":"), source_id.cast("string")).alias("record_id"), F.lit(source).alias("source"), T.display_name(name).alias("name"),
        shown(legal_name).alias("legal_name"), blank(website).alias("website"), address.alias("address"), blank(phone).alias("phone"), cats.alias("categories"),
        seen.alias("evidence"), place.alias("coords"), (employees.cast("int") if employees is not None else F.lit(None).cast("int")).alias("employees"),
    ]


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order; the order must be unique within a key."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
