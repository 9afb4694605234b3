"""Microdata and JSON-LD say the same; pages without ends take linear time."""

import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.operators import markup, microdata

ORDER = {"@type": "Order", "merchant": {"@type": "Organization", "name": "Oak & Rye"}, "orderNumber": "A-77", "price": "12.50", "priceCurrency": "EUR", "orderStatus": "https://schema.org/OrderDelivered"}
PAGE = """<html><body><p itemprop="stray">no item</p><!-- <div itemscope> -->
<div itemscope itemtype="http://schema.org/Order"><script>if (a < b) {"<div itemscope>"}</script>
 <div itemprop="merchant" itemscope itemtype='https://schema.org/Organization'><b itemprop=name>Oak &amp;
   Rye</b></div><meta itemprop="orderNumber" content="A-77"/><span itemprop="price">12.<i>50</i></span>
 <link itemprop="orderStatus" href="https://schema.org/OrderDelivered"><td itemprop="priceCurrency">EUR</td></div></body></html>"""
FLIGHT = """<div itemscope itemtype="schema.org/Thing https://schema.org/flightreservation"><meta itemprop="reservationNumber" content="XK4"><div itemprop="reservationFor" itemscope>
<span itemprop="flightNumber">ZZ 12</span><time itemprop="departureTime" datetime="2026-05-01T08:00">1 May</time><meta itemprop="airline" content="Zed"></div></div>"""


def facts(spark, html, text=None):
    rows = spark.createDataFrame([(1, html, text)], "id long, html string, text string")
    return [r.asDict() for r in markup.facts(rows, "id", "html", "text").collect()]


def test_microdata_equals_json_ld(spark):
    ld = facts(spark, f'<script type="application/ld+json">{json.dumps(ORDER)}</script>')
    assert facts(spark, PAGE) == ld
    assert ld[0] == {"id": 1, "kind": "order", "name": "Oak & Rye", "ref": "A-77", "number": None, "amount": 12.5, "currency": "EUR", "starts": None, "ends": None, "status": "delivered"}


def test_flight_in_microdata(spark):
    (got,) = facts(spark, FLIGHT)
    assert (got["kind"], got["ref"], got["number"], got["starts"], got["name"]) == ("flight", "XK4", "ZZ12", "2026-05-01T08:00", "Zed")


def test_items_of_odd_pages():
    assert microdata.microdata("") == [] and microdata.microdata("<div itemscope") == []
    assert microdata.microdata('<div itemscope><p itemprop="a b">x<p itemprop=a>y') == [{"a": ["x", "y"], "b": "x"}]
    assert microdata.microdata("</b><div itemscope></p><i itemprop=a>1</i></i></div><i itemprop=a>2</i>") == [{"a": "1"}]
    assert microdata.microdata('<div itemscope><img itemprop=a src="x"><img itemprop=b></div>') == [{"a": "x"}]
    assert microdata.microdata("<div itemscope><p itemprop='a>b'>x</p><!-- <p itemprop=c>y") == [{"a>b": "x"}]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/\"'= itemscoprdv!-", max_size=60))
def test_any_page_has_some_items(page):
    microdata.microdata(page)


def test_time_is_linear(spark):
    for bad in ("<script>", '<p itemprop="', "<!--", "</x>", "<div itemscope itemprop=a>", "<div itemscope>" + "<p>" * 5 + "</b>"):
        began = time.time()
        microdata.microdata("<div itemscope>" + bad * 20_000)
        assert time.time() - began < 15, bad
    pages = spark.createDataFrame([("<script>" * 30_000,), ("<script></style>" * 20_000,), ("</script>" * 20_000,)], "h string")
    began = time.time()
    pages.select(F.length(X.html_text(F.col("h")))).collect()
    assert time.time() - began < 60


def test_html_text_keeps_what_is_never_closed(spark):
    rows = ["a<script>b</script>c", "a<script>b<style>c</head>d", "a</style>b", "a<script>b", "<header>x</header>", "<HEAD>x</Head>y", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "h string").select(X.html_text(F.col("h"))).collect()]
    assert got == ["a c", "a d", "a b", "a b", "x", "y", ""]


def test_odd_json(spark):
    for html in ('<script type="application/ld+json">{broken</script>', "<script type=application/ld+json>", None, ""):
        assert facts(spark, html) == []
    many = '<script type="application/ld+json">[{"@type":["Thing","order"],"orderNumber":" 5 "},{"@type":"Order","seller":["A","B"],"price":7}]</script>'
    assert [(f["kind"], f["ref"], f["name"], f["amount"]) for f in facts(spark, many)] == [("order", "5", None, None), ("order", None, "A", 7.0)]
    escaped = '<SCRIPT type="application/ld+json">{&quot;@type&quot;:&quot;Order&quot;,&quot;orderNumber&quot;:&quot;9&quot;}</SCRIPT >'
    assert facts(spark, escaped)[0]["ref"] == "9"


def test_facts_are_worked_out_once(spark):
    """No condition in front repeats the work, and a field that is used twice is looked up once."""
    page = '<script type="application/ld+json">{"@type":"Order","orderNumber":"R-1","merchant":[{"name":" Shop "}],"price":"1.234,50","priceCurrency":"EUR","orderStatus":"http://schema.org/OrderPastDue","seller":null}</script>'
    df = spark.createDataFrame([(1, page, "")], "id long, html string, text string")
    made = markup.facts(df, "id", "html", "text")
    assert made.drop("number", "starts", "ends").collect() == [(1, "order", "Shop", "R-1", 1234.5, "EUR", "overdue")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Filter" not in plan
    shown = lambda c: spark.range(1).select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("try_variant_get")
    one = markup.said(F.try_parse_json(F.lit('{"a":"x"}')), "a")
    assert shown(markup.state(one)) == shown(markup.number(one)) == shown(one) == 5
