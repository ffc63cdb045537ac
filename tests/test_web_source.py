"""The web data source and the visitor against a server on this machine."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from firmscope.functions.region import Region
from firmscope.sources import net, registry, web_source

PEOPLE = [{"number": str(i), "enumeration_type": "NPI-2", "basic": {"organization_name": f"Clinic {i}"}} for i in range(7)]


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def _send(self, body, kind="application/json", status=200, **headers):
        self.server.seen[self.path.split("?")[0]] += 1
        data = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        at = urlsplit(self.path)
        asked = {k: v[0] for k, v in parse_qs(at.query).items()}
        if at.path == "/people":
            skip, n = int(asked["skip"]), int(asked.get("limit", 3))
            self._send(json.dumps({"results": PEOPLE[skip : skip + n]}))
        elif at.path == "/npi":
            skip = int(asked["skip"])
            self._send(json.dumps({"results": (PEOPLE * 60)[skip : skip + 200]} if asked["state"] == "OR" else {"Errors": [{"description": "bad state"}]}))
        elif at.path.startswith("/listing/"):
            name = f"{at.path.rsplit('/', 1)[1]} {asked['PlantState']} Works"
            self._send(f"<hr noshade> <br> <table><font size='+2'>{name}</font><td align='left'>1 Elm St</td><td align='left'>Salem, OR 97301</td></table><strong>Facility :</strong> Salem, OR<br>", "text/html")
        elif at.path == "/robots.txt":
            self._send("User-agent: *\nDisallow: /kept", "text/plain")
        elif at.path in ("/page", "/kept"):
            self._send("<p>" + "x" * 3000, "text/html; charset=utf-8")
        elif at.path == "/big":
            self._send('"' + "x" * 3000 + '"')
        elif at.path == "/away":
            self._send("", status=302, Location="/page")
        else:
            self._send("no", status=404)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        n = 2 if body["page"] < 3 else 1
        self._send(json.dumps({"results": [{"k": f"{body['page']}-{i}"} for i in range(n)], "meta": {"more": body["page"] < 3}}))


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.seen = Counter()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_read_with_paging(spark, server):
    at = f"http://127.0.0.1:{server.server_port}"
    other = f"http://localhost:{server.server_port}"
    requests = [
        {"url": f"{at}/people", "params": {"limit": 3}, "paging": {"param": "skip", "step": 3, "size": 3, "items": "results"}},
        {"url": f"{other}/search", "post": {"q": "x"}, "paging": {"param": "page", "first": 1, "items": "results", "more": "meta.more"}},
        {"url": f"{at}/none"},
        {"url": f"{other}/page", "kind": "page"},
        {"url": f"{at}/kept", "kind": "page"},
        {"url": f"{at}/away", "kind": "page"},
        {"url": f"{at}/people", "params": {"limit": 2}, "paging": {"param": "skip", "step": 2, "size": 2, "items": "results", "most": 3}},
        {"url": f"{at}/big"},
        {"url": f"{at}/people?skip=0", "kind": "page"},
    ]
    found = web_source.answers(spark, requests, private=True, pace=0, cap=2000)
    assert found.rdd.getNumPartitions() == 2  # hosts
    rows = {(r.request, r.page): r for r in found.collect()}
    assert [len(json.loads(rows[0, p].payload)["results"]) for p in range(3)] == [3, 3, 1] and (0, 3) not in rows
    assert [len(json.loads(rows[1, p].payload)["results"]) for p in range(3)] == [2, 2, 1] and (1, 3) not in rows
    assert "404" in rows[2, 0].error and rows[2, 0].payload is None
    assert len(rows[3, 0].payload) == 2000 and "robots.txt" in rows[4, 0].error and rows[5, 0].url.endswith("/page")
    assert {p for r, p in rows if r == 6} == {0, 1}
    assert "more than 2000 bytes" in rows[7, 0].error and "no page" in rows[8, 0].error
    with pytest.raises(Exception, match="no answer from"):
        web_source.usable(found).collect()


def test_robots_are_asked_once_a_host(server):
    server.seen.clear()
    visitor = net.Visitor("me", 0, private=True)
    for _ in range(3):
        visitor.visit(f"http://127.0.0.1:{server.server_port}/page")
    assert server.seen == {"/robots.txt": 1, "/page": 3}
    with pytest.raises(net.NetError):  # a guarded visitor doesn't go to local hosts
        net.Visitor("me", 0).visit(f"http://127.0.0.1:{server.server_port}/page")


def test_fetched(spark, server):
    at = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{at}/page",), (f"{at}/away",), (f"{at}/kept",)], "url string")
    got = {r.url.rsplit("/", 1)[-1]: r for r in net.fetched(urls, "me", 0, private=True).collect()}
    assert got["page"].body and got["away"].final.endswith("/page") and got["kept"].error


def test_registry_live_and_saved(spark, server, tmp_path):
    url = f"http://127.0.0.1:{server.server_port}/npi"
    spec = {"url": url, "live": True, "private": True, "pace": 0, "taxonomy_descriptions": ["Dentist"], "max_results": 400}
    live = registry.npi(spark, spec, Region(regions=["OR"]))
    assert {r.record_id for r in live.collect()} == {f"npi:{i}" for i in range(7)}
    with pytest.raises(Exception, match="bad state"):
        registry.npi(spark, spec, Region(regions=["OR", "??"])).collect()
    page = lambda request, page, some, **other: {"request": request, "page": page, "url": url, "payload": json.dumps({"results": some} | other)}
    rows = [page(0, 0, PEOPLE[:2]), page(0, 1, PEOPLE[2:3]), page(0, 2, PEOPLE[3:4]), page(1, 0, PEOPLE[4:6]), page(1, 1, []), page(1, 2, PEOPLE[6:])]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    saved = lambda **spec: sorted(r.record_id for r in registry.npi(spark, {"answers": str(tmp_path), "page_size": 2} | spec, Region()).collect())
    assert saved() == ["npi:0", "npi:1", "npi:2", "npi:4", "npi:5"]
    assert saved(max_results=2) == ["npi:0", "npi:1", "npi:4", "npi:5"]
    with pytest.raises(registry.SourceError):
        registry.npi_requests({}, Region())


def test_certification_listings_live(spark, server):
    spec = {"url": f"http://127.0.0.1:{server.server_port}/listing/{{program}}", "live": True, "private": True, "pace": 0}
    rows = {r.name: r.evidence[0] for r in registry.nsf(spark, spec, Region(regions=["OR", "WA"])).collect()}
    assert len(rows) == 4 and {e.detail for e in rows.values()} == {"NSF/ANSI/CAN 61 drinking water components: plant in Salem, OR", "NSF plumbing system components: plant in Salem, OR"}
    assert any("PlantState=WA&PlantCountry=UNITED+STATES" in e.url and "Standard=061" in e.url for e in rows.values())
    for bad, region in (({"programs": ["x"]}, Region(regions=["OR"])), ({}, Region())):
        with pytest.raises(registry.SourceError):
            registry.nsf_programs(bad, region)
