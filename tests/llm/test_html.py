import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from spanfold.llm.html import build, extract_text, to_text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x</ol></ul>", "- a\n- b\n  3. x"),
        ("<table><tr><th>Name<th>n<tr><td>apple<td>3</table>", "Name  | n\napple | 3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table>stray<tr><td>x</table>", "stray\n\nx"),
        ("<div style='display:none'>no</div>yes<span hidden>no</span>", "yes"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<head><title>t</title></head><body>b", "b"),
        ("<title>t</title>b<script>if (a<b) '</p>'</script>c", "bc"),
        ("<pre>  a\n   b</pre>", "  a\n   b"),
        ("x &amp; &lt;y&gt; &copy;", "x & <y> ©"),
        ("<!-- no -->a<!-- never closed", "a"),
        ("<a href='1>2'>in</a> <b title=\"</p>\">out", "in out"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("a <b> b </b> c", "a b c"),
        ("<h1>H</h1>text<h2>I</h2>", "H\n\ntext\n\nI"),
        ("cut off <a href=", "cut off"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("", ""),
    ],
)
def test_rendering(source, text):
    assert to_text(source) == text


class Words(HTMLParser):
    """Words outside head, scripts and styles: another way to the same words."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style", "noscript", "template")
        if tag == "li":
            self.words.append("-")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style", "noscript", "template")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_words_of_real_pages(spark, sf):
    """All characters but white space, none more and none less, of every page."""
    for row in extract_text(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").withColumn("source", F.col("html")), text_col="t").collect():
        other = Words()
        other.feed(row.source)
        other.close()
        assert "".join(row.t.split()) == "".join("".join(other.words).split()), row.page_id


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x y=2"),
        ("<svg><title>no</title><path d=a /><style/><g>no<text>one</text><text>two</text></g></svg>end", "one\ntwo\nend"),
        ("<svg><circle r=1><p>left open", "left open"),
        ("<div style='display:none'><svg><text>no</text></svg></div>yes", "yes"),
        ("<svg><foreignObject><div>in<b>side</b></div></foreignObject></svg>", "inside"),
        ("<object data=x>shown</object> <video>no</video>", "shown"),
        ("<select><optgroup label=Fruit><option>apple<option label=Pear>p</optgroup></select>", "Fruit\napple\nPear"),
        ("<table><tr><td>" + "w" * 200 + "<td>b<tr><td>a<td>c</table>", "w" * 200 + " | b\n" + "a".ljust(120) + " | c"),
    ],
)
def test_what_else_is_seen(source, text):
    assert to_text(source) == text


@pytest.mark.parametrize("depth", [250, 5_000, 60_000])
def test_rules_hold_at_any_depth(depth):
    inner = "<div hidden><b>no</b></div><noscript>no</noscript><ul><li>yes</ul><table><tr><td>a<td>b<tr><td>long<td>c</table>"
    assert to_text("<div>" * depth + inner) == "- yes\n\na    | b\nlong | c"
    assert to_text("<b>" * depth + "<i>x</i>" * 100 + "</u>" * depth) == "x" * 100


def test_time_grows_with_the_length():
    """Pages that make a search through open elements, or a stray text's place, long."""
    import time

    for page in ("<table>" + "stray<tr>" * 60_000, "<b>" * 40_000 + "<p>x</i>" * 40_000, "<table><tr><td>" + "<i>" * 40_000 + "<li>x" * 40_000, "<blockquote>x" * 20_000):
        began = time.process_time()
        assert to_text(page)
        assert time.process_time() - began < 30


def test_edge_rows(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    rows = [(1, "<p>a", "mine"), (None, None, "mine"), (1, "<p>a", "mine"), (2, "", None), (3, deep, None), (4, "<p>w" * 50_000, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, Page_Text string")
    got = extract_text(df).collect()
    assert list(got[0].asDict()) == ["page_id", "page_text"]
    assert [r.page_text for r in got][:5] == ["a", None, "a", "", "x"]
    assert got[5].page_text.count("w") == 50_000
    assert extract_text(df.limit(0)).collect() == []


def test_quotes_that_never_close_take_linear_time():
    assert to_text("<a title=\"" * 3000) is not None
    assert build("<i " * 3000).children


def test_rows_without_a_table(spark):
    pages = ["<div><tr>x", "<table><tr><td>a</table><tr>x", "<tbody>x<tr><td>y", "<thead>x</thead><tfoot>y", "<p>fine"]
    got = extract_text(spark.createDataFrame([(s,) for s in pages], "html string")).collect()
    assert [r.page_text for r in got] == ["x", "a\n\nx", "x\ny", "xy", "fine"]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><form><td>x</td></form></tr></table>", "x"),
        ("<table><tbody><form><tr><td>x<td>y</form><tr><td>z</table>end", "x | y\nz |\n\nend"),
        ("<table><tbody><div>d<p>e</div><tr><td>x</table>", "d\n\ne\n\nx"),
        ("<table><tr><b>b</b><td>x<p>y</table>", "b\n\nx\ny"),
        ("<table><a href=q>l</a><tr><td>x</table>", "l\n\nx"),
        ("<table><tr><td>1</td><table><tr><td>2</table>3", "1\n\n2\n\n3"),
        ("<table><colgroup>c<col><div>d</div><tr><td>x</table>", "c\nd\n\nx"),
        ("<table><tr><td>a<table><tr><b>q</b><td>b</table>c</table>", "aq\nb\nc"),
        ("<table><tr><template><td>no</template><td>y</table>", "y"),
    ],
)
def test_what_a_table_may_not_hold_stands_before_it(source, text):
    assert to_text(source) == text


def test_no_word_of_tables_is_lost():
    draw = random.Random(1)
    tags = "table tr td th thead tbody tfoot caption colgroup col form div p b a ul li span select option pre h1 br input".split()
    for _ in range(3000):
        pieces, words = [], []
        for n in range(draw.randrange(3, 25)):
            pieces.append(f"<{'/' if draw.random() < 0.3 else ''}{draw.choice(tags)}>")
            if draw.random() < 0.6:
                words.append(f"w{n}z")
                pieces.append(words[-1])
        text = to_text("".join(pieces))
        assert [w for w in words if text.count(w) != 1] == [], "".join(pieces)
