"""HTML to Markdown and character references against results written by hand."""
import html as library

import pytest
from pyspark.sql import functions as F

from claimlake.functions import html, references

CASES = {
    "<h1>T</h1><p>a <b class=x>b</b> c<i></i> <a href='u'>l</a>": "# T\n\na **b** c [l](u)",
    "<ol><li>one<li>two<ul><li>x</li><li>y<p>z</p></li></ul></li><li>three</li></ol><p>after": "1. one\n2. two\n   * x\n   * y\n\n     z\n3. three\n\nafter",
    "<ol start=7><li>a</li></ol><ul><li>a<ul><li>b<ul><li>c</ul></ul></ul>": "7. a\n\n* a\n  + b\n    - c",
    "<pre>a  b\n  c &lt;</pre><p>x <code>y z</code></p><img src=a.png alt='p q'>": "```\na  b\n  c <\n```\n\nx `y z`\n\n![p q](a.png)",
    "<blockquote><p>a</p><p>b</p><ul><li>c</ul></blockquote>d<hr>e<br>f": "> a\n>\n> b\n>\n> * c\n\nd\n\n---\n\ne  \nf",
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2 <b>x</b></tr></table>": "| a | b |\n| --- | --- |\n| 1 | 2 **x** |",
    "<table><tr><td>q|</td><td>r</td></tr></table>z": "|  |  |\n| --- | --- |\n| q\\| | r |\n\nz",
    "<p><b>T<br><p>next</p><a href=/x><div>blk</div></a>": "**T**\n\nnext\n\n[blk](/x)",
    "plain &mdash; &#8217; text": "plain — ’ text", "<script>var a='<p>'</script><!-- <p>no --><p>yes": "yes", "": "", "</ul></b></td><li></li><b></b>": "", None: None,
    "<a>no link</a> 1 < 2 <unknown>kept</unknown>": "no link 1 < 2 kept",
    "<ul><li>" + "w<br>" * 700 + "end</ul>": "* " + "w  \n  " * 700 + "end",
}


def test_markdown_of_nested_pages(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, h string").select("i", html.html_to_markdown(F.col("h")).alias("m"))
    got = {r.i: r.m for r in df.collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


@pytest.mark.parametrize("text", ["&#38;lt; &amp;amp; &eacute; &alpha; &lt &bogus; &;& a&b", "&#x2014;&#150;&#0;&#1;&#xD800;&#99999999999; &#0065;&#x41", "&CounterClockwiseContourIntegral; &copy 2020 &NotEqualTilde;"])
def test_references_are_read_once(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(references.decoded(F.col("t")).alias("d")).first().d == library.unescape(text)


def test_names_without_semicolon_stay_in_markdown(spark):
    text = "<title>a &amp;&amp; b &amp</title><p>x &copy 2020 &ampx &#8217 &copy;"
    assert spark.createDataFrame([(text,)], "h string").select(html.html_to_markdown(F.col("h")).alias("m")).first().m == "a && b &amp\n\nx &copy 2020 &ampx ’ ©"
