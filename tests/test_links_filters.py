"""Links of pages and the event filter on literal rows."""

import datetime
import html as html_library
from html.entities import html5

from pyspark.sql import functions as F

from parley.functions import markup
from parley.operators import analytics, links


def test_document_links(spark):
    html = """<a class=x href="/docs/2024/20240115-plan%20b.pdf">PDF</a><A HREF='../up/minutes.docx?x=1&amp;y=2'>The <b>Minutes</b></A>
    <a href=agenda.xlsx></a><a href="/docs/2024/20240115-plan%20b.pdf">again</a><a href="/about.html">About</a><a href="//cdn.org/z.zip">Zip of all</a><a name="n">no</a>"""
    pages = spark.createDataFrame([(1, "http://a.org/m/list/index.html", html), (2, None, None), (3, "http://a.org", "<a href='b.pdf'>Bee</a>")], "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): r for r in links.document_links(pages).collect()}
    assert set(got) == {(1, "http://a.org/docs/2024/20240115-plan%20b.pdf"), (1, "http://a.org/m/up/minutes.docx?x=1&y=2"), (1, "http://a.org/m/list/agenda.xlsx"), (1, "http://cdn.org/z.zip"), (3, "http://a.org/b.pdf")}
    plan = got[1, "http://a.org/docs/2024/20240115-plan%20b.pdf"]
    assert plan["filename"] == "20240115-plan b.pdf" and str(plan["posted_date"]) == "2024-01-15" and plan["title"] not in ("PDF", "again", "") and plan["position"] == 0
    assert got[1, "http://a.org/m/up/minutes.docx?x=1&y=2"]["title"].split() == ["The", "Minutes"]
    assert got[1, "http://a.org/m/list/agenda.xlsx"]["title"] != ""


def test_filter_events_view_facet_and_nested_text(spark):
    schema = "id long, title string, committee string, rto string, meeting_date date, issues array<struct<name:string,native_id:string>>, documents array<struct<title:string,stakeholders:array<struct<entity:string,name:string>>>>"
    rows = [(1, "T", None, "PJM", [("Storage Rules", "I-7")], None), (2, "T", "C", "PJM", None, [("Queue Report", None), (None, [("Acme", "Ann Lee")])]), (3, "T", "C", "SPP", None, None)]
    events = spark.createDataFrame([(i, t, c, r, None, s, d) for i, t, c, r, s, d in rows], schema).withColumn("meeting_date", F.date_add(F.lit("2024-01-20").cast("date"), F.col("id").cast("int")))
    ids = lambda **how: sorted(r["id"] for r in analytics.filter_events(events, **how).collect())
    assert [ids(text=q) for q in ("i-7", "queue report", "acme", "ann lee", "spp")] == [[1], [2], [2], [2], [3]]
    assert ids(view="today", today="2024-01-22", week_end="2024-01-23") == [2, 3]
    assert ids(facet=events.where("id <> 2"), text="t") == [1, 3]


def test_references_read_as_the_standard_library_reads_them(spark):
    cases = [f"x&{n} y" for n in html5] + [f"&{n}z;" for n in html5 if not n.endswith(";")]
    cases += [f"&#{n};" for n in (*range(0, 300), 8217, 55295, 55296, 57343, 64976, 65534, 65535, 128512, 1114111, 1114112, 99999999, 10**30)] + ["&#x27;&#X1F600;&#xD800;&#xfffe;", "&#0000000000038;", "&#;", "&#x;", "& &&amp;amp; &notit; &notin;", "&ampamp;", "", "a & b", "&" * 40, "&#38&#38", "é&eacute;\ud7ff"]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, s string").select("i", markup.unescape(F.col("s")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: html_library.unescape(c) for i, c in enumerate(cases)}


def test_markup(spark):
    cases = ["<p>a</p><P>b</P>c<br>d<br />e", "<td>1</td><td>2</td>", "x<script>if (a<b) {}</script>y<style>p{}</style>", "  \u3000 ", None, "<b></b>", "a &lt;b&gt; \t c\n \u00a0\n d", "one</h2>two</section>three"]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, s string").select("i", markup.markup_to_text(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == ["a\nbc\nd\ne", "1 2", "x y", None, None, None, "a <b> c\nd", "one\ntwothree"]


def test_links_by_source(spark):
    pages = {
        "pjm": ("https://www.pjm.com/x/y", """<table><tr><td><input></td><td>4.16.2026</td><td><a href="/-/media/a/20260416-item-05---plan.ashx">PDF</a></td></tr><tr><td>only</td></tr></table>
            <a href="/files/B.PDF">no</a><a href="b.pdf">Bee &amp; Co</a><a href="https://other.org/c.pdf">no</a>"""),
        "caiso_initiative": ("https://stakeholdercenter.caiso.com/i/1", """<td><a href="/InitiativeDocuments/Paper%20One">Paper</a> <a href="https://youtu.be/x.pdf">Talk</a> <a href="v.pdf">Video of it</a> <a href="/a/b">none</a> <a href="https://www.caiso.com/documents/n"></a></td>"""),
        "caiso_page": ("https://www.caiso.com/p/", """<a href="d.pdf?x=1">D</a><a href="https://x.org/e.pdf">no</a><a href="f.html">no</a>"""),
        "pjm_issue": ("https://www.pjm.com/i", """<a href="/-/media/q.pdf"> <span>PDF</span> Agenda <b>x</b></a><a href="/-/media/r.pdf"><i>only inner</i></a><a href="/-/media/q.pdf">again</a>"""),
        "ercot": ("https://www.ercot.com/m", """<a download href="/files/docs/2026/05/29/01%20Agenda.docx" title="Agenda &ndash; May">x</a><a download href="/files/z.zip" title="all">z</a><a href="/files/docs/2026/05/29/n.docx">no</a><a  download href="/f/plain.pdf" title=" ">y</a>"""),
        "ferc": ("https://www.ferc.gov/n", """<a href="/sites/default/files/2024-01/E-1%20order.pdf">Download Document / Descargar Documento</a><a href="https://elibrary.ferc.gov/eLibrary/filelist?accession=1">Order &#8217;s</a><a href="https://elibrary.ferc.gov/">eLibrary</a><a href="/x/">About</a>"""),
    }
    want = {
        "pjm": [("https://www.pjm.com/-/media/a/20260416-item-05---plan.ashx", "Item 05 – Plan", datetime.date(2026, 4, 16)), ("https://www.pjm.com/x/b.pdf", "Bee & Co", None)],
        "caiso_initiative": [("https://stakeholdercenter.caiso.com/InitiativeDocuments/Paper%20One", "Paper", None), ("https://www.caiso.com/documents/n", "n", None)],
        "caiso_page": [("https://www.caiso.com/p/d.pdf?x=1", "D", None)],
        "pjm_issue": [("https://www.pjm.com/-/media/q.pdf", "Agenda", None), ("https://www.pjm.com/-/media/r.pdf", None, None)],
        "ercot": [("https://www.ercot.com/files/docs/2026/05/29/01%20Agenda.docx", "Agenda – May", datetime.date(2026, 5, 29)), ("https://www.ercot.com/f/plain.pdf", "plain.pdf", None)],
        "ferc": [("https://www.ferc.gov/sites/default/files/2024-01/E-1%20order.pdf", "E-1 order.pdf", None), ("https://elibrary.ferc.gov/eLibrary/filelist?accession=1", "Order ’s", None)],
    }
    for source, (url, page) in pages.items():
        rows = links.document_links(spark.createDataFrame([(1, url, page)], "page_id long, url string, html string"), source=source).orderBy("position").collect()
        assert [(r["url"], r["title"], r["posted_date"]) for r in rows] == want[source], source
