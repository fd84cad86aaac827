import re
import time

import pytest
from pyspark.sql import functions as F

from isobath.llm import main_text as M
from isobath.llm.queries import OP12_SQL, op12_main_text

SF = "/root/testdata/sf0.001"
LONG = "A paragraph of the article that is long enough to be taken for one, with a second clause to it."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Site title</title>{head}</head><body>{body}</body></html>"


def plain(h):
    """The pages' own template by string operations: what stands in the article, block by block."""
    import html

    inner = (h or "").partition("<article>")[2].rpartition("</article>")[0]
    blocks = re.split("</?(?:h1|p)>", inner)
    own = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
    return "\n".join(b for b in own if b)


def test_query_equals_template_and_sql(spark):
    import duckdb

    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = op12_main_text(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, plain(rows[r.page_id].html), len(r.text))
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW pages AS FROM '{SF}/pages.parquet'")
        assert sorted(duck.sql(OP12_SQL).fetchall()) == sorted(map(tuple, found))


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>Rights</footer>", f"Head\n{LONG}\nShort."),
        (f"<article><header><h1>Head</h1></header><p>{LONG}<aside>Aside {LONG}</aside><p>End.</article>", f"Head\n{LONG}\nEnd."),
        (f"<article><p>{LONG}</p><form><label>Name</label><input><button>Send</button></form><p>End.</p><div class='share-buttons'>Share it</div></article>", f"{LONG}\nEnd."),
        (f"<article><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG} {LONG} {LONG} {LONG} {LONG}</p></article></section>", LONG),
        (f"<article><p>{LONG}</p><article class='x'><p>A comment on it. {LONG}</p></article><p>End.</p></article>", f"{LONG}\nEnd."),
        (f"<main><h1>Head</h1><div><p>{LONG}</p></div><div class=sidebar>{LONG}</div></main><div>Outside.</div>", f"Head\n{LONG}"),
        (f"<div class='page has-sidebar'><div id=menu>A menu</div><div class='layout-with-ads'><p>{LONG}</p><p>Tail.</p></div></div>", f"{LONG}\nTail."),
        (f"<div class='wrapper banner'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div id=header>Site</div><ul><li><a href=1>One link of many</a><li><a href=2>Two links</a></ul><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><ul><li><a>x y z</a><li><a>u v w</a><li><a>r s t</a></ul><p>&copy; 2020 Site</p>", f"Head\n{LONG}\n{LONG}"),
        (f"<table><tr><td><a href=1>Menu</a><td><p>{LONG}</table>", LONG),
        (f"<article><ul><li>One<li>Two <b>bold</b></ul><dl><dt>T<dd>D</dl><pre>a\n  b\tc</pre><table><tr><th>H<td>{LONG}</table></article>", f"One\nTwo bold\nT\nD\na b c\nH\n{LONG}"),
        ("<article><p>a &lt;b&gt; &amp;amp; &#233;&#xe9;&eacute; x&nbsp;y &unknown; AT&T <i>it</i>al<wbr>ic</p></article>", "a <b> &amp; ééé x y &unknown; AT&T italic"),
        ("<article><p>one<br>two<br/>three<p hidden>no<p style='display: none'>no<p aria-hidden=true>no<div role=alert>no</div><p>end</article>", "one two three\nend"),
        ("<article><p>a < b and c > d <3 </p><!-- <p>no</p> --><p>x<!---->y<!-->z</p><![CDATA[q]]><?php no ?></article>", "a < b and c > d <3\nxyz"),
        ("<article><p>an <span class='ad'>advert <a href=x>here</a></span>end <a href='a>b' title=\"<p>\">link</a></p></article>", "an end link"),
        ("<div class=cookie-notice>We use cookies.</div><article><script>document.write('<p>no</p>')</script><style>p{}</style><p>Hi.</p><noscript>no</noscript><template><p>no</p></template></article>", "Hi."),
        ("<ARTICLE CLASS=Post><P>Upper.</P></ARTICLE><DIV CLASS='SideBar side-bar'>no</DIV>", "Upper."),
        ("<p>Hello world.</p>", "Hello world."),
        ("<nav>Only <a href=x>a menu</a></nav><div class=ad>and an advert</div>", ""),
        ("<article></article>", ""),
        (f"<article><p>Teaser</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"Teaser\n{LONG}\n{LONG}"),
        ("<article><p>first <a href=\"unclosed>second</a> third</p></article>", "first second third"),
        ("<article><p>cut <b", "cut"),
        ("<article><p>before</p><script>never closed <p>no</p></article>", "before"),
        ("no markup at all", "no markup at all"),
    ],
)
def test_templates(body, text):
    assert M.main_text(page(body)) == text


def test_surge_and_dive():
    assert M.runs([5, 0, 0, 0, 50, 40, 60, 0, 30, 0, 0, 0, 2], 86) == [(3, 9)]
    assert M.runs([0, 1, 0, 0, 0, 1], 1) == [(0, 2), (3, 6)]
    assert M.runs([], 1) == [] and M.runs([0, 0], 1) == []


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "", 2), (3, "v", page("<article><p>x</p></article>"), 3), (3, "v", page("<article><p>x</p></article>"), 3)]
    found = M.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert found.columns == ["page_id", "url", "text"]
    assert sorted(map(str, found.collect())) == sorted(["Row(page_id=1, url='u', text='')", "Row(page_id=None, url=None, text='')", *["Row(page_id=3, url='v', text='x')"] * 2])
    assert M.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    bad = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), F.expr("CAST(X'3C703E61FF623C2F703E' AS STRING)").alias("html"))
    assert M.extract(bad).first().text == "a�b"


@pytest.mark.parametrize("unit", ["<a \"", "<div>", "<p>x</div>", "<b", "<!--", "</p", "<script>", "<div class=ad><article>", "<a href='", "<li>", "<td><a>", "&amp", "<p>long text here"])
def test_time_is_linear(unit):
    began = time.perf_counter()
    M.main_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_long_pages_are_whole(spark):
    paragraphs = [f"Paragraph {i} &amp; more" for i in range(200_000)]
    body = page("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")
    found = M.extract(spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string")).first()
    assert found.text == "\n".join(paragraphs).replace("&amp;", "&")
