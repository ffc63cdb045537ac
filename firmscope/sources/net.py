"""Polite, guarded reading of the web: public hosts only, redirects checked again, robots.txt kept, one request a second to a host.

Live reading is optional; every reader takes saved payloads. Requests are dealt by host, so one
task owns a host and can keep its pace.
"""

from __future__ import annotations

import ipaddress
import json
import socket
import time
import urllib.request
import urllib.robotparser
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlencode, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.web import domain_of


class NetError(RuntimeError):
    pass


def public_addresses(host: str, resolve=socket.getaddrinfo) -> list[str]:
    """All addresses of a host, if each is public."""
    try:
        found = sorted({a[4][0] for a in resolve(host, None)})
    except OSError as e:
        raise NetError(f"{host} doesn't resolve") from e
    if not found or not all(ipaddress.ip_address(a).is_global for a in found):
        raise NetError(f"{host} isn't a public host")
    return found


def check_url(url: str, resolve=socket.getaddrinfo) -> str:
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise NetError(f"not a web address: {url}")
    public_addresses(parts.hostname, resolve)
    return url


class _Checked(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        check_url(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


@dataclass(frozen=True)
class Answer:
    url: str
    kind: str
    body: str


@dataclass
class Visitor:
    """Who asks hosts, one request after another; kept by a task for the hosts it owns.

    What is asked for decides what becomes of a body over `cap` bytes: half a JSON or XML document or script is
    worth nothing, so those are refused; of a page the first part is kept. Pages and scripts are subject to robots.txt;
    a host without a readable one allows all. `private` lets local hosts through (for tests).
    """

    agent: str
    pace: float = 1.0
    cap: int = 2_000_000
    timeout: float = 20.0
    private: bool = False
    last: dict[str, float] = field(default_factory=dict)
    robots: dict[str, urllib.robotparser.RobotFileParser | None] = field(default_factory=dict)

    def _open(self, url: str, headers: dict[str, str], data: bytes | None, whole: bool) -> Answer:
        if not self.private:
            check_url(url)
        host = urlsplit(url).hostname or ""
        time.sleep(max(0.0, self.last.get(host, -self.pace) + self.pace - time.monotonic()))
        self.last[host] = time.monotonic()
        opener = urllib.request.build_opener() if self.private else urllib.request.build_opener(_Checked)
        try:
            with opener.open(urllib.request.Request(url, data, {"User-Agent": self.agent, **headers}), timeout=self.timeout) as r:
                body = r.read(self.cap + 1)
                if whole and len(body) > self.cap:
                    raise NetError(f"{url} has more than {self.cap} bytes")
                return Answer(r.geturl(), r.headers.get("Content-Type", ""), body[: self.cap].decode(r.headers.get_content_charset() or "utf-8", "replace"))
        except OSError as e:
            raise NetError(f"{url}: {e}") from e

    def may(self, url: str) -> bool:
        parts = urlsplit(url)
        origin = f"{parts.scheme}://{parts.netloc}"
        if origin not in self.robots:
            rules = urllib.robotparser.RobotFileParser()
            try:
                rules.parse(self._open(f"{origin}/robots.txt", {}, None, False).body.splitlines())
                self.robots[origin] = rules
            except NetError:
                self.robots[origin] = None
        kept = self.robots[origin]
        return kept is None or kept.can_fetch(self.agent, url)

    def ask(self, url: str, params: dict[str, Any] | None = None, post: Any = None) -> Answer:
        """An API's answer, whole or refused; `post` is sent as JSON."""
        data = None if post is None else json.dumps(post).encode()
        return self._open(f"{url}?{urlencode(params, doseq=True)}" if params else url, {"Content-Type": "application/json"} if data else {}, data, True)

    def visit(self, url: str, script: bool = False) -> Answer:
        """A page (HTML only) or a script (whole or refused), where robots.txt allows it."""
        if not self.may(url):
            raise NetError(f"robots.txt keeps {url} back")
        found = self._open(url, {}, None, script)
        if not script and "html" not in found.kind.lower():
            raise NetError(f"{url} is no page ({found.kind or 'no type'})")
        return found


def fetched(urls: DataFrame, agent: str, pace: float = 1.0, tasks: int = 16, private: bool = False) -> DataFrame:
    """urls: url. url, final, body, error; each host's pages come from one task at its pace."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visitor = Visitor(agent, pace, private=private)
        for f in frames:
            rows = []
            for url in f["url"]:
                try:
                    found = visitor.visit(url)
                    rows.append((url, found.url, found.body, None))
                except (NetError, ValueError) as e:
                    rows.append((url, None, None, str(e)[:160]))
            yield pd.DataFrame(rows, columns=["url", "final", "body", "error"])

    shape = "url string, final string, body string, error string"
    return urls.select("url").repartition(tasks, domain_of("url")).mapInPandas(run, shape).withColumn("at", F.current_timestamp())
