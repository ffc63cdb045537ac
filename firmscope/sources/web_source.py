"""Live answers of the web as a Spark data source: spark.read.format("firmscope_web").

Options: `requests`, a JSON list; `agent`; and `pace`, `cap`, `timeout`, `private` as for a `Visitor`.
A request is {"url": .., "params": {..}, "post": {..}, "kind": "api" | "page" | "script"}; an API request
may have "paging": {"param": .., "first": 0, "step": 200, "items": "results", "size": 200, "more": "path", "most": 10}:
then `param` (of `params` or of `post`) is counted on by `step`, until a page holds fewer than `size` items, says no at
`more`, or `most` items are read. Partitions are hosts. Rows: request (its place in the list), page (from 0), url, payload,
error; a request that fails gives a row with the error and goes no further, the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .net import NetError, Visitor

ANSWER = "request long, page long, url string, payload string, error string"
Row = tuple[int, int, str, str | None, str | None]


class Host(InputPartition):
    """The requests to one host, with their places."""

    def __init__(self, host: str, requests: list[tuple[int, dict[str, Any]]]):
        super().__init__(host)
        self.requests = requests


def inside(document: Any, path: str) -> Any:
    """What stands at a dotted path, or None; the path "" is the document."""
    for step in filter(None, path.split(".")):
        document = document.get(step) if isinstance(document, dict) else None
    return document


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.requests: list[dict[str, Any]] = json.loads(options["requests"])
        self.visitor = {"agent": options.get("agent", "firmscope"), "pace": float(options.get("pace", 1)), "cap": int(options.get("cap", 2_000_000)), "timeout": float(options.get("timeout", 20)), "private": options.get("private", "false") == "true"}

    def partitions(self) -> Sequence[InputPartition]:
        hosts: dict[str, list[tuple[int, dict[str, Any]]]] = {}
        for place, request in enumerate(self.requests):
            hosts.setdefault(urlsplit(request["url"]).hostname or "", []).append((place, request))
        return [Host(h, r) for h, r in sorted(hosts.items())]

    def read(self, partition: Host) -> Iterator[Row]:
        visitor = Visitor(**self.visitor)
        for place, request in partition.requests:
            yield from self._answers(visitor, place, request)

    def _answers(self, visitor: Visitor, place: int, request: dict[str, Any]) -> Iterator[Row]:
        url, paging, page, read = request["url"], request.get("paging") or {}, 0, 0
        try:
            if request.get("kind", "api") != "api":
                found = visitor.visit(url, request["kind"] == "script")
                yield place, 0, found.url, found.body, None
                return
            while True:
                asked = {k: dict(request[k]) for k in ("params", "post") if request.get(k) is not None}
                if paging:
                    where = asked["post"] if "post" in asked else asked.setdefault("params", {})
                    where[paging["param"]] = paging.get("first", 0) + page * paging.get("step", 1)
                found = visitor.ask(url, asked.get("params"), asked.get("post"))
                yield place, page, found.url, found.body, None
                if not paging:
                    return
                document = json.loads(found.body)
                n = len(inside(document, paging.get("items", "")) or [])
                page, read = page + 1, read + n
                if not n or n < paging.get("size", 1) or read >= paging.get("most", 1 << 60) or ("more" in paging and not inside(document, paging["more"])):
                    return
        except (NetError, ValueError) as e:
            yield place, page, url, None, str(e)[:160]


class WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "firmscope_web"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema: StructType) -> DataSourceReader:
        return WebReader(self.options)


def answers(spark: SparkSession, requests: list[dict[str, Any]], **options: Any) -> DataFrame:
    """All answers to the requests; an option's value may be of any plain type."""
    spark.dataSource.register(WebSource)
    reader = spark.read.format("firmscope_web").option("requests", json.dumps(requests))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


def saved_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers that a collector wrote as JSON rows (request, page, url, payload, error), in the same shape."""
    return spark.read.schema(ANSWER).json(path)


def usable(found: DataFrame) -> DataFrame:
    """The answers themselves; one that failed fails the plan with its error."""
    failed = F.raise_error(F.concat(F.lit("no answer from "), F.coalesce("url", F.lit("?")), F.lit(": "), "error"))
    return found.select("request", "page", "url", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("payload")).alias("payload"))


def until_short(found: DataFrame, items: str, size: int, most: int | None = None) -> DataFrame:
    """The pages of each request up to and with its first short one, and none that begins behind `most` items.

    A saved folder can hold pages of an older, longer run; a collector would not have asked for those. Counts of pages
    alone decide: a page's text stays where it is.
    """
    n = F.coalesce(F.json_array_length(F.get_json_object("payload", "$." + items if items else "$")), F.lit(0))
    before = Window.partitionBy("request").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("request", "page", n.alias("n")).select("request", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.coalesce(F.min("n").over(before), F.lit(size)).alias("least"))
    kept = sizes.filter((F.col("least") >= size) & (F.col("start") < (most if most is not None else 1 << 62)))
    return found.join(kept.select("request", "page"), ["request", "page"], "left_semi")
