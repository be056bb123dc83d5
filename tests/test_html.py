import html

import pytest

from pyspark.sql import functions as F

from docloom.functions import htmltext as H


@pytest.mark.parametrize("page, text", [
    ("<p>a <b>b</b>  c</p><p>d</p>", "a b c\n\nd"),
    ("x<h1>T</h1>y", "x\n\n✪ T\ny"),
    ("<ul><li>x<UL><li>y</li></UL></li><li>z</li></ul>end", "  ∙ x\n    ∙ y\n  ∙ z\nend"),
    ("<Div>a</Div><p>b", "a\n\nb"),
    ("x<pre>\n a  b\n  c\n</pre>y", "x\n┃ \n┃  a  b\n┃   c\ny"),
    ("<!-- c <p> --><script>if(a<b){'</p>'}</script>ok<img alt='>' src=x>k", "okk"),
    ("a<br>b &lt;i&gt;", "ab <i>"),
    ("</ul></p>a", "a"),
])
def test_to_text(value, page, text):
    assert value(H.to_text, page).lstrip("\n") == text


@pytest.mark.parametrize("text", [
    "&eacute;&#233;&#xE9;&#XE9", "&copy2 &notit; &amp;lt; &bogus; &#128; &#150;", "AT&T && &;", "&hearts;",
    "&#0; &#55296; &#1114112; &#1;x", "&nbsp;&quot;&AMP;&amp", "&NotEqualTilde;", "plain"])
def test_entities(value, text):
    assert value(H.decode_entities, text) == html.unescape(text)


def test_audits(value):
    page = "<p>a<blink>b</blink><div class=x>c<div class='src'><span>d<span class=\"k\"><br>"
    assert sorted(value(H.unknown_marks, page)) == [
        ("div class", "x"), ("tag", "blink"), ("tag", "br")]
    assert ("br", 1) not in value(H.tag_events, page)


def test_number_references_of_any_length(value):
    from docloom.functions import htmltext
    for html, text in (("&#0000000065;x", "Ax"), ("&#x000000041;x", "Ax"), ("&#9999999999;x", "\ufffdx")):
        assert value(htmltext.to_text, html).strip() == text


def test_unclosed_elements_take_time_in_proportion(spark):
    import time

    def took(n):
        page = "<p>a</p>" + "<style>" * n + "</script>" + "<script>" * n + "b"
        df = spark.createDataFrame([(page,)], "html string").select(H.strip_hidden(F.col("html")).alias("t"))
        start = time.time()
        assert df.first().t == page
        return time.time() - start

    took(10)
    assert took(20_000) < 2.5


def test_hidden_elements(spark):
    def strip(page):
        return spark.createDataFrame([(page,)], "html string").select(H.strip_hidden(F.col("html")).alias("t")).first().t

    assert strip("a<script>x</style></script>b<style>c") == "ab<style>c"
    assert strip("a<STYLE type='x>y'>s<script></Style >b<script>d</script >e<script>") == "abe<script>"
    assert strip("a<!-- <script> -->b</script>c<!-- d") == "ab</script>c<!-- d"
    assert strip("<styles>a</styles><style>b</style>") == "<styles>a</styles>"


def brute_mismatch(events):
    stack = []
    for pos, (tag, step) in enumerate(events):
        if step > 0:
            stack.append((pos, tag))
        elif not stack:
            return pos, "stray end", tag, None
        elif stack[-1][1] != tag:
            return pos, "wrong end", tag, stack[-1][1]
        else:
            stack.pop()
    return (stack[0][0], "no end", stack[0][1], None) if stack else None


def test_first_mismatch_equals_a_stack(spark):
    import random

    from docloom.operators import markup as G
    r = random.Random(6)
    pages, want = [], {}
    for i in range(300):
        events, open_ = [], []
        for _ in range(r.randrange(14)):
            if open_ and r.random() < 0.5:
                events.append((open_.pop() if r.random() < 0.9 else r.choice("abp"), -1))
            elif r.random() < 0.05:
                events.append((r.choice("abp"), -1))
            else:
                open_.append(r.choice("abp"))
                events.append((open_[-1], 1))
        if r.random() < 0.7:
            events += [(t, -1) for t in reversed(open_)]
        pages.append((i, "x<br>".join(f"<{'/' if s < 0 else ''}{t}>" for t, s in events)))
        want[i] = brute_mismatch(events)
    pages += [(1000, None), (1001, ""), (1002, "<p>" * 20_000 + "</p>" * 20_000), (1003, "<i>" * 20_000)]
    want[1003] = (0, "no end", "i", None)
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {x.page_id: (x.pos, x.kind, x.tag, x.expected) for x in G.first_mismatch(df).collect()}
    assert got == {k: v for k, v in want.items() if v}
