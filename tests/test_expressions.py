import html
import unicodedata

from pyspark.sql import functions as F

from groundset.functions import text, urls, values
from groundset.functions.evidence import evidence_position, grounding_context, with_evidence_found


def test_stable_ranges_are_stable():
    treated_alike = {0xA0, 0x2007, 0x202F, 0x2026}
    for low, high in text._STABLE_RANGES:
        for code in range(low, high + 1):
            if code not in treated_alike:
                assert unicodedata.normalize("NFKC", chr(code)) == chr(code), hex(code)


def test_match_form_equals_the_stepwise_rule(column):
    smart = "“Hi” ‘a’ x–y—z … &amp; A B​C  ﬁ ① &lt;b&gt;"
    samples = [smart, "  Plain\n\ttext ", "café ＡＢ", "", "a & b", "R&amp;D `x`"]

    def expected(s):
        s = unicodedata.normalize("NFKC", html.unescape(s))
        for code, char in text._FOLDED.items():
            s = s.replace(chr(code), char)
        return " ".join(s.replace("…", "...").split()).lower()

    assert column(samples, text.normalize_for_match) == [expected(s) for s in samples]


def test_normalize_string(column):
    assert column(["  a   b\n", "", "   ", None], text.normalize_string) == ["a b", None, None, None]


def test_key_text(column):
    got = column(["Acme, Inc.", "Stripe LLC", "Foo Limited", "Bar Corp.", "École co", None], text.key_text)
    assert got == ["acme", "stripe", "foo", "bar", "école", ""]


def test_key_text_of_numbers(spark):
    df = spark.createDataFrame([(0, 0.0, False), (7, 1.2e7, True)], "a int, b double, c boolean")
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(*[text.key_text(F.col(c), types[c]).alias(c) for c in "abc"]).collect()
    assert [tuple(r) for r in rows] == [("", "", ""), ("7", "120000000", "true")]


def test_chunks(column):
    texts = ["short text", "x" * 20_000, "x" * 60_000]
    sizes = column(texts, lambda c: F.transform(text.chunks(c), F.length))
    assert sizes == [[10], [8000, 8000, 5000], [8000] * 7 + [7500]]
    sizes = column(texts, lambda c: F.transform(text.chunks(c, max_chunks=4), F.length))
    assert sizes == [[10], [8000, 8000, 5000], [8000] * 4]
    assert len(column(["x" * 60_000], lambda c: text.chunks(c, max_chunks=None))[0]) == 8


def test_urls(column):
    given = [
        "https://Example.com/p?utm_source=x&id=1#top", "javascript:alert(1)", "data:text/html,x", "vbscript:x",
        "/jobs/1", "", None, "http://a.b/?x=&y=1&y=2&z=a+b",
    ]
    got = [tuple(r) for r in column(given, urls.normalize_url)]
    assert got == [
        ("https://example.com/p?id=1", True), (None, False), (None, False), (None, False),
        ("/jobs/1", True), (None, True), (None, True), ("http://a.b/?y=1&y=2&z=a+b", True),
    ]
    based = column(["/jobs/1", "b", "../c?q=1", "?q=2", "//h.org/p"], lambda c: urls.normalize_url(c, F.lit("https://x.com/a/d/e?z=1"))["url"])
    assert based == [
        "https://x.com/jobs/1", "https://x.com/a/d/b", "https://x.com/a/c?q=1", "https://x.com/a/d/e?q=2", "https://h.org/p",
    ]


def test_safe_href(column):
    given = [
        None, "", "   ", "http://example.com", "http://example.com/path?q=1", "https://example.com/path",
        "javascript:alert(1)", "JaVaScRiPt:x", "java\tscript:x", "java\nscript:x", "data:text/html,x", "  javascript:x",
        "/relative/path", "  https://example.com", "file:///etc/passwd", "ftp://example.com/file",
    ]
    want = [None] * 16
    want[3], want[4], want[5], want[13] = (
        "http://example.com/", "http://example.com/path?q=1", "https://example.com/path", "https://example.com/",
    )
    assert column(given, urls.safe_href) == want


def test_addresses(column):
    given = ["127.0.0.1", "10.0.0.1", "192.168.1.1", "172.16.0.1", "172.32.0.1", "8.8.8.8", "::1", "fe80::1", "2606:4700::1111", "a.com", "01.2.3.4", "192.0.0.9"]
    want = ["private"] * 4 + ["public", "public", "private", "private", "public", "name", "name", "public"]
    assert column(given, urls.address_class) == want


def test_private_pattern_equals_the_blocks(column):
    import ipaddress
    import random

    rng = random.Random(5)
    nets = [ipaddress.ip_network(b) for b in urls.IPV4_BLOCKS]
    edges = [int(n.network_address) + d for n in nets for d in (-1, 0)] + [int(n.broadcast_address) + d for n in nets for d in (0, 1)]
    ips = [ipaddress.ip_address(x % 2**32) for x in edges + [rng.randrange(2**32) for _ in range(300)]]
    want = [any(ip in n for n in nets) and str(ip) not in urls.IPV4_GLOBAL for ip in ips]
    assert column([str(ip) for ip in ips], urls.is_private_ipv4) == want


def test_date_spellings(column):
    given = {
        "Jan. 5, 2024": "2024-01-05", "January 5th, 2024": "2024-01-05", "5 Jan. 2024": "2024-01-05", "Sept 5, 2024": "2024-09-05",
        "Monday, January 5, 2024": "2024-01-05", "2024-01-05T10:00:00.123Z": "2024-01-05", "2024-01-05 10:00": "2024-01-05",
        "05.01.2024": "2024-01-05", "13/01/2024": "2024-01-13", "5-Jan-2024": "2024-01-05", "01/05/24": "2024-01-05",
        "March 2024": "2024-03-01", "may 1st 2024": "2024-05-01", "Mon Jan 40, 2024": None, "31/31/2024": None, None: None,
    }
    assert column(list(given), values.normalize_date) == list(given.values())


def test_numbers_dates_currency(column):
    assert column(["$120,000.50", "  15,000  ", "abc", None, "10-20", "$1.1B"], values.normalize_number) == [120000.5, 15000.0, None, None, None, 1.1]
    dates = ["2024-01-15", "January 15, 2024", "Jan 5, 2024", "15 March 2024", "01/15/2024", "never", "May 2, 2024", "2024-13-40"]
    assert column(dates, values.normalize_date) == [
        "2024-01-15", "2024-01-15", "2024-01-05", "2024-03-15", "2024-01-15", None, "2024-05-02", None,
    ]
    assert column(["₹5", "Rs. 5", "5 dollars", "€5", "5 pounds", "5"], values.detect_currency) == ["inr", "inr", "usd", "eur", "gbp", None]


def test_retry_delay(column):
    got = column(["Please retry in 33.95s.", "'retryDelay': '48s'", "retry after 20 seconds", "none"], text.retry_delay)
    assert got == [33.95, 48.0, 20.0, None]


def test_safe_cell(column):
    given = ["=1+1", "+1", "-1", "@x", "  =1", "\t=1", "plain", "", "%x"]
    assert column(given, text.safe_cell) == ["'=1+1", "'+1", "'-1", "'@x", "'  =1", "'\t=1", "plain", "", "'%x"]


def test_usable_text(column):
    article = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Big</h1><p>" + "word " * 30 + "</p></article></body></html>"
    thin = "<body><p>" + "x" * 60 + "</p><nav>" + "y" * 40 + "</nav></body>"
    got = column([article, thin, "<p>tiny</p>"], text.usable_text)
    assert got[0].startswith("Big\n") and "menu" not in got[0]
    assert "y" * 40 in got[1]
    assert got[2] is None


def test_evidence_and_context(spark):
    rows = [("Acme raised $5M", "News: Acme  raised $5M today"), ("missing words", "nothing of the sort"), ("", "x")]
    df = spark.createDataFrame(rows, "e string, p string")
    given = (F.col("e") != "") & (F.col("p") != "")
    sides = text.normalize_for_match(F.col("e")), text.normalize_for_match(F.col("p"))
    found = with_evidence_found(df.coalesce(1), "found", given, *sides)
    assert [r["found"] for r in found.collect()] == [True, False, False]
    page = "Header Jane\n---\nbefore Acme Corp after\n\nnext block"
    ctx = spark.createDataFrame([("Acme Corp", page)], "e string, p string").select(
        grounding_context(F.col("e"), F.col("p"), evidence_position(F.col("e"), F.col("p")))
    )
    assert ctx.first()[0] == "\nbefore Acme Corp after"
