"""Sources by name: each reads what a collector saved and gives records; one that fails never stops the others.

A source's entry in a profile names its type, the path of its payloads and its own options.
Readers are of one form, (spark, spec, region) to records.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import Region
from ..operators.staging import staged
from . import listings, registries, web_source

Reader = Callable[[SparkSession, dict[str, Any], Region], DataFrame]


class SourceError(RuntimeError):
    """A source whose payloads can't be used."""


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """pos, url (the file's name) and payload of saved answers; their order is that of their names."""
    rows = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.col("value").alias("payload"), name.alias("pos"), name.alias("url"))


#: The registry's address, its page and how far it lets a reader skip.
NPI_URL, NPI_PAGE, NPI_SKIP = "https://npiregistry.cms.hhs.gov/api/", 200, 1000


def npi_requests(spec: dict[str, Any], region: Region) -> list[dict[str, Any]]:
    """One request for each trade, state and city that the profile names."""
    if not region.regions:
        raise SourceError("the registry needs the region's states")
    most = min(int(spec.get("max_results", 600)), NPI_SKIP + NPI_PAGE)
    paging = {"param": "skip", "first": 0, "step": NPI_PAGE, "size": NPI_PAGE, "items": "results", "most": most}
    base = {"version": "2.1", "enumeration_type": "NPI-2", "limit": NPI_PAGE}
    return [
        {"url": spec.get("url", NPI_URL), "params": base | {"taxonomy_description": trade, "state": state} | ({"city": city} if city else {}), "paging": paging}
        for trade in spec.get("taxonomy_descriptions") or []
        for state in region.regions
        for city in spec.get("cities") or [None]
    ]


def npi(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    """Result pages of the registry, live, as saved answers, or as files of one request; an answer that holds errors fails the source.

    A request's pages end with its first short one, and with the page that reaches `max_results`.
    """
    if spec.get("live"):
        found = web_source.answers(spark, npi_requests(spec, region), agent=spec.get("agent", "firmscope"), private=bool(spec.get("private")), pace=spec.get("pace", 1))
    elif spec.get("answers"):
        found = web_source.saved_answers(spark, spec["answers"])
    else:
        files = whole_files(spark, spec["path"])
        number = files.groupBy().agg(F.array_sort(F.collect_list("pos")).alias("names"))  # the names of one request's few pages
        found = files.crossJoin(F.broadcast(number)).select(F.lit(0).cast("long").alias("request"), (F.array_position("names", F.col("pos")) - 1).alias("page"), "url", "payload", F.lit(None).cast("string").alias("error"))
    return registries.npi_answers(web_source.usable(found), int(spec.get("page_size", NPI_PAGE)), int(spec["max_results"]) if spec.get("max_results") else None)


#: The census of establishments by county, and what is asked of it.
CENSUS_URL, CENSUS_GET = "https://api.census.gov/data/{year}/cbp", "ESTAB,EMPSZES_LABEL,NAICS2017_LABEL"


def census_requests(coverage: dict[str, Any], key: str, url: str = CENSUS_URL) -> list[dict[str, Any]]:
    """One request for each industry code and state of a search's coverage block; a block without codes or counties can't be counted."""
    codes, counties = [str(c) for c in coverage.get("naics") or []], coverage.get("counties") or {}
    if not codes or not counties:
        raise SourceError("coverage needs industry codes and counties")
    return [
        {"url": url.format(year=int(coverage.get("year", 2022))), "params": {"get": CENSUS_GET, "for": f"county:{','.join(map(str, some))}", "in": f"state:{state}", "NAICS2017": code, "key": key}}
        for code in codes
        for state, some in counties.items()
    ]


def osm(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    only = region.regions[0] if len(region.regions) == 1 and len(region.regions[0]) == 2 else None
    return registries.osm(whole_files(spark, spec["path"]), only)


def csv_list(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    stem = spec["path"].rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return registries.read_csv_list(spark, spec["path"], stem, spec.get("label") or stem)


def postings(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    return registries.postings(spark.read.schema("pos long, company string, title string, url string, location string, posting_text string").json(spec["path"]))


def web_search(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    answers = spark.read.schema("seq long, query string, payload string").json(spec["path"])
    listed = spark.read.text(spec["skip_list"]).select(F.trim("value").alias("domain")) if spec.get("skip_list") else None
    return listings.web_search(listings.search_results(answers, spec.get("provider", "brave")), spec.get("skip_domains"), listed)


# The certifier's programmes, their labels and parameters, and where their listings are.
PROGRAMS = {"PwsComponents": ("NSF/ANSI/CAN 61 drinking water components", {"Standard": "061"}), "Plumbing": ("NSF plumbing system components", {})}
LISTINGS_URL = "https://info.nsf.org/Certified/{program}/Listings.asp"


def listing_url(program: str, state: str, base: str = LISTINGS_URL) -> str:
    return base.format(program=program) + "?" + urlencode(PROGRAMS[program][1] | {"PlantState": state, "PlantCountry": "UNITED STATES"})


def nsf_programs(spec: dict[str, Any], region: Region) -> list[tuple[str, str]]:
    """(programme, state) of each listing that the profile asks for."""
    asked = spec.get("programs") or list(PROGRAMS)
    if not region.regions:
        raise SourceError("certification listings need the region's states")
    if strange := [p for p in asked if p not in PROGRAMS]:
        raise SourceError(f"no programmes of the certifier: {', '.join(strange)}")
    return [(p, s) for p in asked for s in region.regions]


def nsf(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    """Certification listings, live (each programme's in each state) or as saved pages under one label."""
    match = spec.get("product_match") or spec.get("match")
    if not spec.get("live"):
        return listings.nsf(whole_files(spark, spec["path"]).withColumnRenamed("payload", "html"), spec.get("label") or "Certified", match)
    asked = nsf_programs(spec, region)
    requests = [{"url": listing_url(p, s, spec.get("url", LISTINGS_URL)), "kind": "page"} for p, s in asked]
    found = web_source.usable(web_source.answers(spark, requests, agent=spec.get("agent", "firmscope"), private=bool(spec.get("private")), pace=spec.get("pace", 1)))
    label = F.get(F.array(*[F.lit(PROGRAMS[p][0]) for p, _ in asked]), F.col("request").cast("int"))
    return listings.nsf(found.select(F.col("request").alias("pos"), "url", F.col("payload").alias("html"), "request"), label, match)


def first_csv_member(packages: Iterable[pa.RecordBatch], most: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Archives (content, path) to lists of fields: the rows of the first CSV in each, read as a stream; pos counts them from 0, the header."""
    for batch in packages:
        for data, path in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                names = [n for n in z.namelist() if n.lower().endswith(".csv")]
                if not names:
                    raise ValueError(f"no CSV in {path}")
                held: list[list[str]] = []
                at = 0
                with z.open(names[0]) as raw:
                    for fields in csv.reader(io.TextIOWrapper(raw, "utf-8-sig", "replace", newline="")):
                        held.append(fields)
                        if len(held) == most:
                            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + most), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["pos", "fields"])
                            at, held = at + most, []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["pos", "fields"])


def zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """pos and the columns of the first CSV inside a ZIP, as text."""
    archives = spark.read.format("binaryFile").load(path).select("content", "path")
    rows = staged(archives.mapInArrow(first_csv_member, "pos long, fields array<string>"), "zipped-csv")
    head = rows.filter("pos = 0").first()
    if head is None:
        raise SourceError(f"nothing in {path}")
    return rows.filter("pos > 0").select("pos", *[F.get("fields", F.lit(i)).alias(name.strip()) for i, name in enumerate(head["fields"])])


def osha(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    """The yearly filings, as CSV (also compressed) or as the first CSV in a ZIP."""
    if spec["path"].lower().endswith(".zip"):
        rows = zipped_csv(spark, spec["path"])
    else:
        rows = spark.read.option("header", True).csv(spec["path"])
        rows = rows.withColumn("pos", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return registries.osha(rows, [str(n) for n in spec["naics"]], region)


def yc(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    rows = spark.read.text(spec["path"], wholetext=True).select(F.explode(F.from_json("value", registries.YC)).alias("c")).select("c.*")
    statuses = tuple(s.lower() for s in spec.get("statuses") or ["active"])
    return registries.yc(rows, region, spec.get("industries"), statuses, spec.get("team_size_min"), spec.get("team_size_max"), bool(spec.get("hiring_only")), spec.get("funded_since"))


def form_d(spark: SparkSession, spec: dict[str, Any], region: Region) -> DataFrame:
    """Filings with their staged documents: the list of filings (pos, cik, adsh, form, file_date) and, by accession number, the XML."""
    filings = spark.read.schema("pos long, cik long, adsh string, form string, file_date string, xml string").json(spec["path"])
    if spec.get("documents"):
        saved = whole_files(spark, spec["documents"]).select(F.regexp_replace(F.regexp_replace("url", r"\.[A-Za-z]+$", ""), "-", "").alias("key"), F.col("payload").alias("saved"))
        filings = filings.withColumn("key", F.regexp_replace("adsh", "-", "")).join(saved, "key", "left").withColumn("xml", F.coalesce("xml", "saved")).drop("key", "saved")
    if spec.get("max_filings"):
        filings = filings.orderBy("pos").limit(int(spec["max_filings"]))
    return registries.form_d(filings, spec.get("industries") or [], not spec.get("amendments"))


#: Types that a profile may name.
READERS: dict[str, Reader] = {
    "npi": npi, "osm": osm, "csv": csv_list, "postings": postings, "web_search": web_search, "nsf": nsf, "osha_ita": osha, "yc_directory": yc, "sec_form_d": form_d,
}


#: Signs that the driver or its context is lost, which is no source's fault.
LOST = ("OutOfMemoryError", "SparkContext was shut down", "stopped SparkContext")


def discovered(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[tuple[str, str, int, str]]]:
    """Records of all sources and a log of (source, status, count, error).

    Spark is lazy, so each source is written to the stage folder here: that is where it would fail, and
    later steps read what was written instead of the payloads again.
    """
    frames, log = [], []
    for name, read in sources.items():
        try:
            rows = staged(read(), "source")
            log.append((name, "ok", rows.count(), ""))
            frames.append(rows)
        except (SourceError, ValueError, KeyError, OSError, PySparkException) as e:
            if any(sign in str(e) for sign in LOST):
                raise
            log.append((name, "failed", 0, str(e).splitlines()[0][:160] if str(e) else type(e).__name__))
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), log


def status_of(log: list[tuple[str, str, int, str]]) -> str:
    """ok, partial or failed; a search without sources is ok."""
    good = sum(x[1] == "ok" for x in log)
    return "ok" if good == len(log) else "partial" if good else "failed"


def discover(spark: SparkSession, specs: list[dict[str, Any]], region: Region) -> tuple[DataFrame | None, list[tuple[str, str, int, str]], str]:
    """Records of a search's sources, the log of each, and the search's status."""
    named: dict[str, Callable[[], DataFrame]] = {}
    for spec in specs:
        kind = spec["type"]
        key = kind if kind not in named else f"{kind} {sum(k.split(' ')[0] == kind for k in named) + 1}"
        named[key] = lambda spec=spec: READERS[spec["type"]](spark, spec, region)
    rows, log = discovered(named)
    return rows, log, status_of(log)
