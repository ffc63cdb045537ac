"""Page reading against the standard library's parser."""

import html as H
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from firmscope.functions import web as W

HIDDEN = {"script", "style", "noscript", "svg", "template", "iframe"}


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.titled, self.title, self.chunks = 0, False, "", []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in HIDDEN
        self.titled |= tag == "title"

    def handle_endtag(self, tag):
        self.skip -= tag in HIDDEN and self.skip > 0
        self.titled &= tag != "title"

    def handle_data(self, data):
        if self.titled:
            self.title += data
        elif not self.skip:
            self.chunks.append(data)


def plain(page):
    p = Plain()
    p.feed(page)
    return re.sub(r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email removed]", re.sub(r"\s+", " ", " ".join(p.chunks)).strip())


ODD = [
    "", "plain", "<p>a<b>c</b>", "a < b > c", "1<2", "<svg><svg>x</svg>y</svg>z", "<noscript>a<p>b</noscript>c", "</svg>kept", "<template>open to the end", "<script>if (a < b) '</p>'</script>t", "<style>x{}</style >u",
    "<script>never closed <p>x", "<!-- a <p> --> b", "<a title='x > y'>z</a>", '<a title="<svg>">z</a>', "<svg/>kept", "<SVG>x</sVg>y", "<!doctype html>x", "<?php x ?>y", "mail me@x.org now", "<title>T &amp; U</title>v", "<script src=x></script>w",
    "x<p>&lt;b&gt; &copy; &copy &nbsp;&eacute;&Eacute; &notin; &notit; &#65;&#x42;&#X43; &#128; &#0; &#xD800; &#99999999; &unknown; &; &amp;lt; &#; AT&T &ampx end",
]


def test_odd_pages(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k int, html string").select("k", W.page_text("html").alias("t")).collect()
    assert {r.k: r.t for r in rows} == {i: plain(x) for i, x in enumerate(ODD)}


def test_random_pages(spark):
    rng = random.Random(9)
    bits = ["<p>", "</p>", "<svg>", "</svg>", "<noscript>", "</noscript>", "<b class='x > y'>", "</b>", "<script>a<b</script>", "<style>q</style>", "<!-- c -->", "word", " ", "\n", "&amp;", "&lt;p&gt;", "<br/>", "<iframe src=x>", "</iframe>", "<template>", "</template>", "é"]
    pages = ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", W.page_text("html").alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [plain(x) for x in pages]


def test_all_pages_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", W.page_text("html").alias("t")).collect()
    assert len(rows) > 20 and all(r.t == plain(r.html) for r in rows if r.html is not None)


def test_every_reference(spark):
    from html.entities import html5

    texts = [f"a&{name}b" for name in html5] + [f"&#{n};" for n in [*range(0, 300), 8364, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000]] + [f"&#x{n:x} z" for n in (65, 0x20AC, 0x1F600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", W.decoded("t").alias("d")).collect()
    assert [r.d for r in sorted(rows)] == [H.unescape(t) for t in texts]
    assert spark.range(1).select(W.decoded(F.lit(None).cast("string")).alias("d")).first().d is None


def test_queries_of_pages_with_cut_references_equal_their_sql(spark, tmp_path):
    """A title or link cut inside a reference, a bare old name, a page without title, html or address."""
    import duckdb

    from firmscope.plans import names

    titles = ["a &amp; b", "x&amp", "x&am", "Acme &quot", "Acme &copy 2020", "amp and&amp", "q &ltx", "&amp;lt;b&gt;", "a | en | amp", "", None]
    urls = ["https://champ.example.org/x", "https://www.acme-en.example.com/", None]
    page = lambda t: None if t is None else f"<html><title>{t}</title><p>{t} it &copy it &amp</p><a href='/about?x=1&copy=2'>l</a></html>"
    rows = [(n, u, page(t)) for n, (t, u) in enumerate((t, u) for t in titles for u in urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_titles", "title_segments", "page_text", "page_links"):
        found = names.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, duck.sql(names.ORACLE[name]).fetchall())), name


def test_long_pages_keep_their_whole_text(spark, tmp_path):
    import duckdb

    from firmscope.plans import names

    body = "".join(f"<p>Line {n} &amp; more\u00a0words é</p>" for n in range(2000)) + "<p>mail a@b.example.org end</p>"
    rows = [(1, "https://a.example.org/", f"<html><title>t</title>{body}</html>"), (2, "https://b.example.org/", "<p>short</p>"), (3, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in names.QUERIES["page_text"](spark, str(tmp_path)).collect()}
    text = got[1][0]
    assert got[1][1] == len(text) == len(plain(rows[0][2])) > 40000 and text == plain(rows[0][2]) and text.endswith(" end")
    assert got[2] == ("short", 5) and got[3] == (None, None)
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {k: (t, n) for k, t, n in duck.sql(names.ORACLE["page_text"]).fetchall()}
