import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import arrays as A
from docloom.functions import text as X

LINES = "array<string>"
TEXT = st.lists(st.text(alphabet="a@ -*>.:\t`_", max_size=12), min_size=1, max_size=12)
QUIET = dict(deadline=None, max_examples=5, suppress_health_check=list(HealthCheck))

TAGGED = """Replaces child nodes recursively.

@param node The node whose children to replace.
@param fn
  The replacement function.  Takes a node, and returns `None`, a single node, or a
  sequence of nodes.
@param filter
  A filter function.  Takes a node and returns true if it should be replaced."""


def tags(value, lines):
    return value(X.split_tags, lines, LINES)


def test_tags_of_a_docstring(value):
    doc, found = tags(value, TAGGED.split("\n"))
    assert doc == ["Replaces child nodes recursively.", ""]
    assert [t[:2] for t in found] == [("param", "node"), ("param", "fn"), ("param", "filter")]
    assert found[1][2] == (
        "The replacement function.  Takes a node, and returns <code>None</code>, a single node, or a\n"
        "sequence of nodes.")


def test_tag_state_is_sticky(value):
    doc, found = tags(value, ["Sum.", "", "@param x", "  first", "", "  more", "@return v", "tail", ""])
    assert doc == ["Sum.", ""]
    assert found == [("param", "x", "first\n\nmore"), ("return", None, "v\ntail\n")]
    assert tags(value, ["  @param x", "out", "  in"]) == (["out"], [("param", "x", "in")])


def test_what_is_a_tag(value):
    assert tags(value, ["@", "@foo bar", "@param"]) == (
        ["@"], [("foo", None, "bar"), ("param", None, "")])
    assert tags(value, ["no tags", "here"]) == (["no tags", "here"], [])


def test_inline_markup(value):
    text = "a `x` and ``y z`` then _foo number_ is **very big** and *some it* ok _a_ _bb_ _cc_ z"
    assert value(X.inline_markup, text) == (
        "a <code>x</code> and <code>y z</code> then <i>foo number_ is <b>very big</b> and "
        "<i>some it</i> ok _a_ _bb_ _cc</i> z")
    assert value(X.inline_markup, f"a *{'x' * 130}* b") == f"a <i>{'x' * 130}</i> b"
    assert value(X.inline_markup, f"a *{'x' * 131}* b") == f"a *{'x' * 131}* b"


def test_common_indent(value):
    lines = ["Summary.", "    a", "", "      b"]
    assert value(lambda c: X.cut_indent(c, True), lines, LINES) == (4, ["Summary.", "a", "", "  b"])
    assert value(lambda c: X.cut_indent(c, True), ["   one"], LINES) == (3, ["one"])
    assert value(X.cut_indent, ["", " "], LINES) == (0, ["", " "])
    assert value(X.remove_indent, ["", "  "], LINES) is None


@pytest.mark.parametrize("line", ["a\tb", "\t\tx", "abcdefgh\tz", "a\rb\tc", "no tab", "\t"])
def test_tabs(value, line):
    assert value(X.expand_tabs, line) == line.expandtabs()


@pytest.mark.parametrize("text", [
    "", "a", "a\n", "a\r\nb\rc\n", "x y\x85z\x0bq\x1cw\n\n", "\n"])
def test_line_breaks(value, text):
    assert value(X.universal_lines, text) == text.splitlines()


def test_python_white_space(value):
    assert value(X.strip, "　\xa0 a b\x1c ") == "a b"
    assert value(X.is_blank, "\xa0 \t") is True


def test_doctests(value):
    lines = ["x", ">>> a = 1", "... b", "out", "   >>> nested", "", "  >>> z", ">>>", "  o", "  >>> q"]
    assert value(X.doctests, lines, LINES) == [
        (1, "a = 1\nb", "out\n   >>> nested"), (6, "z", ""), (9, "q", "")]


def test_many_doctests(value):
    lines, n = [], 39
    for i in range(n):
        lines += [f">>> f({i})"] + [f"{i}"] * (i % 3)
    found = value(X.doctests, [*lines, ">>>"], LINES)
    assert len(found) == n and sum(bool(o) for _, _, o in found) == 26


def test_body_blocks(value):
    lines = ["S", "", "one:", "", "   c1", "     x", "", "  c2:", "", "      c3", "", "back", "", ">>> t", "1"]
    assert value(X.body_blocks, lines, LINES) == [
        ("text", "one:"), ("code", "c1\n  x\n\nc2:\n\nc3\n"), ("text", "back"), ("doctest", "&gt;>> t\n1".replace("&gt;", ">"))]


def test_bullets(value):
    assert value(X.bullet, "**bold") == ("*", "*bold")
    assert value(X.bullet, "  -  x") == ("-", "  x")
    assert value(X.bullet, "x - y") == (None, "x - y")


def test_bullet_lists(value):
    lines = ["Here is a list.", "", "- Item 0.", "", "- Item 1.  Long", "the second line.", "",
             "- Item 2.", "and more", "", "That's the end."]
    found = value(X.bullet_lists, lines, LINES)
    assert [[t for _, t in items] for items in found] == [
        ["Item 0.\n", "Item 1.  Long\nthe second line.\n", "Item 2.\nand more\n"]]
    nested = ["- a", "  - a1", "  - a2", "- b", "* c"]
    assert [[t for _, t in i] for i in value(X.bullet_lists, nested, LINES)] == [
        ["a\n  - a1\n  - a2", "b"], ["c"]]


def test_blocks(value):
    lines = ["a", "  b", "", "c", "d", "", "  e", "", ""]
    assert [b[::2] for b in value(X.blocks, lines, LINES)] == [
        ("P", "a"), ("DIV", "  b\n"), ("P", "c\nd"), ("DIV", "  e\n\n")]
    assert value(X.blocks, [">>> x", "y"], LINES) == [("DOCTEST", 0, ">>> x\ny")]
    assert [b[::2] for b in value(X.indent_groups, lines, LINES)][:2] == [("LINE", "a"), ("DIV", "  b\n")]


def test_elide_and_length(value):
    assert value(lambda c: X.elide(c, 5), "abcdefg\nabc") == "abcd…\nabc"
    assert value(X.visible_length, "\x1b[1mab\x1b[0mc") == 3


def test_parse_doc(value):
    doc = "  Foo *is it* <b>.\n    More.\n\n    Rest.\n\n    @param p  desc\n"
    parsed = value(X.parse_doc, doc)
    assert parsed[1:3] == ("Foo <i>is it</i> &lt;b&gt;. More.", "Rest.")
    assert parsed[3] == [("param", "p", "desc")]
    assert value(X.parse_doc, "# Title\n\ntext")[1] is None
    assert value(X.parse_doc, None) is None


@settings(**QUIET)
@given(TEXT)
def test_tag_lines_are_all_accounted_for(spark, lines):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    d = X.split_tags(F.col("l"))
    row = df.select(F.size(d["doc_lines"]).alias("d"), F.size(d["tags"]).alias("t")).first()
    starts = [bool(re.match(r"\s*@\S", x)) for x in lines]
    assert row.t == sum(starts)
    first = starts.index(True) if any(starts) else len(lines)
    assert row.d >= first


@settings(**QUIET)
@given(TEXT)
def test_paragraphs_keep_all_text(spark, lines):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    pars = df.select(X.paragraphs(F.col("l")).alias("p")).first().p
    assert [x for p in pars for x in p.split("\n")] == [x for x in lines if x.strip()]


def test_long_text_is_linear(spark):
    n = 60_000
    lines = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(
        i % 3 == 0, F.concat(F.lit("@param p"), i)).otherwise("  text"))
    df = spark.range(1).select(lines.alias("l"))
    row = df.select(X.split_tags(F.col("l")).alias("d")).select(
        F.size("d.tags").alias("t"), F.size("d.doc_lines").alias("n")).first()
    assert (row.t, row.n) == (n // 3, 2)


def test_arrays(value):
    one, three = F.lit(1), F.lit(3)
    assert value(lambda c: A.span(one, three, inclusive=True), 0, "int") == [1, 2, 3]
    assert value(lambda c: A.span(one, three, inclusive=False), 0, "int") == [2]
    assert value(lambda c: A.span(three, one), 0, "int") == []
    assert value(lambda c: A.span(one, three, inclusive=(False, True)), 0, "int") == [2, 3]
    assert value(lambda c: A.dot(c, F.array(F.lit(2.0), F.lit(3.0))), [1.0, 1.0, 9.0], "array<double>") == 5.0


def test_subsets_are_rows(spark):
    from itertools import combinations

    from docloom.operators.sequence import subset_rows
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None), (4, ["x"])], "id int, items array<string>")
    got = sorted((r.id, r.size, r.subset) for r in subset_rows(df, "items").collect())
    want = sorted((i, k, list(s)) for i, items in ((1, "abc"), (2, ""), (4, "x"))
                  for k in range(len(items) + 1) for s in combinations(items, k))
    assert got == want
    many = spark.range(1).selectExpr("transform(sequence(0, 34), x -> x) AS items")
    rows = subset_rows(many, "items", largest=4).select("size", "subset").collect()
    found = {tuple(r.subset) for r in rows}
    assert len(rows) == len(found) == 1 + 35 + 595 + 6545 + 52360
    assert found == {s for k in range(5) for s in combinations(range(35), k)}


def test_labels_do_not_depend_on_the_blocks(spark, monkeypatch):
    """State passes from block to block: any block size gives the labels of one fold."""
    unit = ["Text:", "", "  >>> f(1)", "  ... more", "  out", "- item", "  more", "", "- item 2", "* other"]
    rows = [(unit * 3,), ([],), (None,), (["- a"],), ([" >>> x"] + ["out"] * 20,)]
    df = spark.createDataFrame(rows, f"lines {LINES}")
    folds = [X.doctest_labels, X.bullet_labels, lambda ls: X.block_labels(ls, F.lit(0))]

    def labels(block):
        monkeypatch.setattr(X, "BLOCK", block)
        return df.select(*[f(F.col("lines")).alias(f"c{i}") for i, f in enumerate(folds)]).collect()

    whole = labels(10_000)
    assert [len(r.c0) for r in whole if r.c0 is not None] == [30, 0, 1, 21]
    assert list(whole[2]) == [None, None, None]
    assert labels(1) == labels(3) == labels(7) == whole
