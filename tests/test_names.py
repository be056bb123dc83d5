import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import names as N

QUIET = dict(deadline=None, max_examples=5, suppress_health_check=list(HealthCheck))
IDENT = st.from_regex(r"[A-Za-z_][A-Za-z0-9_]{0,8}", fullmatch=True)


@pytest.mark.parametrize("name, want", [
    ("A.B.__x", "A.B._B__x"), ("C.__init__", "C._C__init__"), ("__x", None), ("A.x", None)])
def test_mangle(value, name, want):
    assert value(N.mangle, name) == want


@pytest.mark.parametrize("name, want", [
    ("_Foo__bar", ("Foo", "__bar")), ("__init__", (None, "__init__")), ("_x", (None, "_x")),
    ("x", (None, "x")), ("_A__b__c", ("A", "__b__c"))])
def test_unmangle(value, name, want):
    assert value(N.unmangle, name) == want


@pytest.mark.parametrize("ref, want", [
    ("#/modules/m.n/dict/A/dict/f", ("m.n", "A.f")), ("#/modules/m.n", ("m.n", None)),
    ("#/modules/m/dict/dict/dict/x", ("m", "dict.x")), ("#/modules/m/attr/A", None),
    ("/modules/m", None), ("#/modules/", None), ("#/modules/m/dict", None)])
def test_parse_ref(value, ref, want):
    assert value(N.parse_ref, ref) == want


@pytest.mark.parametrize("parts, want", [
    (["foo", "bar.baz"], "foo.bar.baz"), (["foo"], "foo"), (["foo", ""], None), ([""], None)])
def test_join_name(spark, parts, want):
    row = spark.range(1).select(N.join_name(*[F.lit(p) for p in parts]).alias("r")).first()
    assert row.r == want


def test_dotname_parts(value):
    name = "foo.bar.baz"
    assert value(N.last_part, name) == "baz"
    assert value(N.parent_name, name) == "foo.bar"
    assert value(N.ancestor_names, name) == ["foo.bar", "foo"]
    assert value(N.prefix_names, name) == ["foo", "foo.bar", "foo.bar.baz"]
    assert value(lambda c: N.with_last(c, F.lit("bif.bof")), name) == "foo.bar.bif.bof"
    assert value(N.parent_name, "foo") is None
    assert value(N.ancestor_names, "foo") == []


@pytest.mark.parametrize("path, root, want", [
    ("/foo/bar/baz/bif", "/foo/bar", True), ("/foo/barbaz/bif", "/foo/bar", False),
    ("/foo/bar", "/foo/bar", True), ("/foo/bar", "/", True), ("/foo/bar", "/foo/", True)])
def test_subpath(value, path, root, want):
    assert value(lambda c: N.is_subpath(c, F.lit(root)), path) is want


@pytest.mark.parametrize("name, want", [
    ("a.b_1", True), ("é.ñ", True), ("1a", False), ("a..b", False), ("", False), ("a b", False),
    ("a\n", False)])
def test_qualname(value, name, want):
    assert value(N.is_qualname, name) is want


@settings(**QUIET)
@given(st.lists(st.tuples(
    st.lists(IDENT, min_size=1, max_size=3), st.lists(IDENT, max_size=4)), min_size=1, max_size=30))
def test_refs_round_trip(spark, paths):
    rows = [(".".join(m), ".".join(q) or None) for m, q in paths]
    df = spark.createDataFrame(rows, "m string, q string")
    back = N.parse_ref(N.make_ref(F.col("m"), F.col("q")))
    got = df.select("m", "q", back["modname"].alias("bm"), back["qualname"].alias("bq")).collect()
    assert all((r.m, r.q) == (r.bm, r.bq) for r in got)


@settings(**QUIET)
@given(st.lists(st.lists(IDENT, min_size=1, max_size=5), min_size=1, max_size=30))
def test_split_and_join(spark, names):
    df = spark.createDataFrame([(".".join(n),) for n in names], "n string")
    got = df.select("n", N.join_parts(N.parts(F.col("n"))).alias("back")).collect()
    assert all(r.n == r.back for r in got)
