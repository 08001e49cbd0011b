import pytest

from essenta.llm.html_text import extract, extract_text
from tests.llm.odd import table

CASES = {
    "one <b>two</b>\n three": "one two three",
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "<h1>t</h1>x<br>y<br><br>z": "t\n\nx\ny\n\nz",
    "<ul><li>a<li>b<ol><li>c<li value=7>d</ol><li>e</ul>": "- a\n- b\n   1. c\n   7. d\n- e",
    "<ol start=9><li>a<li>b</ol>": " 9. a\n10. b",
    "<dl><dt>k<dd>v<dt>l<dd>w</dl>": "k\n  v\nl\n  w",
    "<table><tr><th>Name<th>N<tr><td>long cell<td>1<td>x</table>after": "Name       N\nlong cell  1  x\n\nafter",
    "<table><tr><td colspan=2>all of it<tr><td>a<td>b</table>": "all of it\na  b",
    "<table><tr><td>x<table><tr><td>in<td>ner</table></table>": "x\n\nin  ner",
    "<pre>a\n  b\n</pre>": "a\n  b",
    "a<script>var t='</p>'</script><style>p{}</style><!-- no --><noscript>n</noscript>b": "ab",
    "<div hidden>n</div><p style='color:red; display : none'>n</p><span style='visibility:hidden'>n</span>y": "y",
    "<style>.ad, #x {display:none} b i{display:none}</style><p class='c ad'>n</p><p id=x>n</p><b><i>y</i></b>": "y",
    "<details><summary>s</summary>n</details><details open><summary>t</summary>y</details>": "s\nt\ny",
    "&amp;&lt;&copy;&#x41; &nbsp;x": "&<©A \xa0x",
    "</p></div>x</table></li>": "x",
    "<![CDATA[n]]><!doctype x><?php n ?>x<": "x<",
    "<select><option>n</select><textarea>n</textarea><button>go</button>": "go",
    "": "",
    "   \n ": "",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert extract(html)[1] == CASES[html]


def test_title_and_nesting():
    assert extract("<html><head><title> A\n b </title></head><body>x") == ("A b", "x")
    assert extract(None) == ("", "")
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert extract(deep)[1] == "x"
    assert isinstance(extract("<b" * 2000)[1], str)


def test_pages(spark):
    rows = table(spark, "pages").collect()
    got = {r.page_id: r for r in extract_text(table(spark, "pages")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.page_id].title, got[r.page_id].text) == extract(r.html)
        assert "<p" not in got[r.page_id].text and "track(" not in got[r.page_id].text and "margin" not in got[r.page_id].text


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (None, "<p>x", None, 2), (1, None, "a", 1), (2, "", "", 3), (3, "<p>" + "w " * 200_000, "t", 4)],
                                 "page_id long, html string, title string, rest int")
    got = extract_text(docs)
    assert got.columns == ["page_id", "rest", "title", "text"] and got.count() == 5
    assert extract_text(docs.limit(0)).collect() == []


SHOWN = {
    "<style>@media print{.nav,p{display:none}} @media (max-width:600px){.s{display:none}}</style><p class=nav>a</p><b class=s>b</b>": "a\n\nb",
    "<style media=print>p{display:none}</style><style media='screen'>b{display:none}</style><p>a</p><b>n</b>": "a",
    "<style>@media screen{.x{display:none}} @import 'a;b{'; .y{display:none}</style><b class=x>n</b><b class=y>n</b>a": "a",
    "<style>.x{display:none} .x{display:block} .y{display:none!important} .y{display:block}</style><b class=x>a</b><b class=y>n</b>": "a",
    "<style>p{display:none} #k{display:block} @supports (a:b){b{display:none}}</style><p>n</p><p id=k>a</p><b>b</b>": "a\n\nb",
    "<style>.x{visibility:hidden} .x{display:block}</style><b class=x>n</b><b class=x style='visibility:visible'>a</b>": "a",
    "<style>.x{content:'}';display:none;color:red}</style><b class=x>n</b>a": "a",
    "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=t>n</annotation></math>": "x=1",
    "a<svg><title>n</title><defs><text>n</text></defs><path d=n style='display:none'/><g><text>b</text><text>c</text></g></svg>d": "a b c d",
    "<object data=x><param name=n value=n>a</object>": "a",
    "<input type=submit value=Send><input type=hidden value=n><input type=button hidden value=n>": "Send",
}


@pytest.mark.parametrize("html", SHOWN)
def test_shown_on_screens(html):
    assert extract(html)[1] == SHOWN[html]
