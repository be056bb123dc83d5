import gzip
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import session
from docloom.functions import objects as O
from docloom.operators import members as M
from docloom.operators import refs as R
from docloom.sources import cache as C
from docloom.sources import docset as D
from docloom.sources import extract as E
from docloom.sources import inventory as V
from docloom.streaming.refresh import refresh_available

FILES = {
    "pkg/__init__.py": "",
    "pkg/_priv.py": "x = 1\n",
    "pkg/core.py": '''"""Core."""
import os.path as osp
import collections
from . import _priv, helper as h
from .sub.deep import Thing
__all__ = ("run", "Box")

def run(x, y=0):
    """Does it.

    @param x  first
    """

class Box(Thing):
    total = 0
    def __hide(self): pass
    @property
    def size(self):
        """The size."""
    @size.setter
    def size(self, v): pass
    @staticmethod
    def make(): pass
    class Inner: pass
''',
    "pkg/helper.py": "",
    "pkg/sub/__init__.py": "from .deep import Thing\n",
    "pkg/sub/deep.py": "class Thing:\n    pass\n",
    "pkg/star.py": "from .core import *\nfrom .sub import *\n",
    "pkg/plain/lost.py": "x = 1\n",
    "pkg/plain/inner/__init__.py": "",
    "pkg/plain/inner/gone.py": "",
    "top.py": "def broken(:\n",
    "__init__.py": "",
    "latest.py": "",
    "notes.txt": "no",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("src")
    for name, text in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def modules(spark, root):
    return V.modules(V.list_files(spark, [root])).cache()


def names(df, column="modname"):
    return sorted(r[0] for r in df.select(column).collect())


def test_discovery(spark, root, modules):
    want = ["latest", "pkg", "pkg._priv", "pkg.core", "pkg.helper", "pkg.star", "pkg.sub", "pkg.sub.deep", "top"]
    assert names(modules) == want
    assert names(V.standard_modules(modules)) == want[1:]
    assert names(V.submodules(modules, "pkg.sub")) == ["pkg.sub", "pkg.sub.deep"]
    assert names(V.modules_in_path(spark, [root, root, "/no/such/root"], "/no/such")) == sorted(want * 2)


@pytest.fixture(scope="module")
def raw(modules):
    return E.parse_sources(V.read_sources(modules)).cache()


def test_extraction(raw, modules):
    good, failed = E.split_errors(raw)
    assert names(failed) == ["top"]
    core = {r.qualname: r for r in E.objects(good).filter("modname = 'pkg.core'").collect()}
    assert set(core) == {None, "run", "Box", "Box.total", "Box._Box__hide", "Box.size", "Box.make", "Box.Inner"}
    assert (core["run"].line_start, core["run"].line_end) == (7, 12)
    assert core["Box"].bases == ["Thing"] and core["Box.make"].type_name == "staticmethod"
    assert core["Box.size"].doc == "The size." and core[None].doc == "Core."
    assert E.exports(good).first().all_names == ["run", "Box"]
    params = [(r.name, r.default_repr) for r in E.params(good).filter("qualname = 'run'").collect()]
    assert params == [("x", None), ("y", "0")]
    assert sorted(r.role for r in E.accessor_rows(good).collect()) == ["get", "set"]


def test_imports_resolve(raw, modules):
    edges = E.settle_module_targets(E.aliases(raw, modules.filter("is_package")), modules)
    got = {(r.modname, r.member_name): (r.target_mod, r.target_qual) for r in edges.collect()}
    assert got == {
        ("pkg.core", "osp"): ("os.path", None), ("pkg.core", "collections"): ("collections", None),
        ("pkg.core", "_priv"): ("pkg._priv", None), ("pkg.core", "h"): ("pkg.helper", None),
        ("pkg.core", "Thing"): ("pkg.sub.deep", "Thing"), ("pkg.sub", "Thing"): ("pkg.sub.deep", "Thing")}
    ends = R.resolve_aliases(edges)
    assert ends.filter("is_cycle").count() == 0
    stars = E.star_aliases(raw, modules.filter("is_package"))
    assert sorted(tuple(r) for r in stars.collect()) == [
        ("pkg.star", "Box", "pkg.core", "Box"), ("pkg.star", "Thing", "pkg.sub", "Thing"),
        ("pkg.star", "run", "pkg.core", "run")]


DOCSET = {"modules": {
    "m": {"name": "m", "type_name": "module", "all_names": None, "type": {"$ref": "#/modules/builtins/dict/module"}, "dict": {
        "C": {"name": "C", "type_name": "type", "bases": [{"$ref": "#/modules/m/dict/B"}], "dict": {
            "p": {"type_name": "property", "get": {"type_name": "function", "callable": True}, "set": None},
            "s": {"type_name": "staticmethod", "func": {"type_name": "function", "callable": True,
                  "signature": {"params": [{"name": "x", "kind": "KEYWORD_ONLY", "default": {"repr": "1"},
                                            "annotation": {"$ref": "#/modules/builtins/dict/int"}}]}}}}},
        "B": {"$ref": "#/modules/n/dict/B", "exported": True}}},
    "n": {"name": "n", "type_name": "module", "dict": {"B": {"type_name": "type", "source": {"lines": [3, 9]}}}}}}


def test_read_docset(spark, tmp_path):
    with gzip.open(tmp_path / "set.json.gz", "wt") as file:
        json.dump(DOCSET, file)
    nodes = D.flatten(D.read_documents(spark, str(tmp_path))).cache()
    objects = {(r.modname, r.qualname, r.role): r for r in D.objects(nodes).collect()}
    assert set(objects) == {
        ("m", None, "self"), ("m", "C", "self"), ("m", "C.p", "self"), ("m", "C.p", "get"),
        ("m", "C.s", "self"), ("m", "C.s", "func"), ("n", None, "self"), ("n", "B", "self")}
    assert (objects["m", None, "self"].has_all_names, objects["m", None, "self"].all_names) == (True, None)
    assert objects["n", None, "self"].has_all_names is False
    assert objects["n", "B", "self"].line_end == 9
    refs = [tuple(r) for r in D.members(nodes).filter("is_ref").collect()]
    assert refs == [("m", None, "B", True, "n", "B", True)]
    assert [tuple(r)[3:8] for r in D.params(nodes).collect()] == [(1, "x", "KEYWORD_ONLY", "1", "int")]
    assert [tuple(r) for r in R.base_edges(D.ref_edges(nodes, "bases")).collect()] == [("m", "C", 0, "m", "B")]


def test_wrappers_inside_wrappers(spark):
    made = {"type_name": "function", "callable": True, "dict": {"inner": {"type_name": "int", "dict": {"deep": {"$ref": "#/modules/n"}}}}}
    doc = {"modules": {"m": {"type_name": "module", "dict": {"C": {"type_name": "type", "dict": {
        "w": {"type_name": "classmethod", "callable": False, "func": {"type_name": "staticmethod", "func": {
            "type_name": "wrapper", "func": made}}},
        "t": {"type_name": "staticmethod", "func": {"type_name": "wrapper", "func": {"type_name": "type", "callable": True}}},
        "p": {"type_name": "property", "get": {"type_name": "wrapper", "func": {"type_name": "function"}}, "del": None}}}}}}}
    nodes = D.flatten(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    got = {(r.qualname, r.role) for r in nodes.collect()}
    assert got == {
        (None, "self"), ("C", "self"), ("C.w", "self"), ("C.w", "func"), ("C.w", "func.func"), ("C.w", "func.func.func"),
        ("C.w.inner", "self"), ("C.w.inner.deep", "self"), ("C.t", "self"), ("C.t", "func"), ("C.t", "func.func"),
        ("C.p", "self"), ("C.p", "get"), ("C.p", "get.func")}
    joined = M.attach_innermost(D.objects(nodes), ["callable", "type_name"])
    like = {r.qualname: (r.wraps, r.f) for r in joined.select("qualname", "wraps", O.is_function_like(
        F.col("wraps"), F.col("callable"), F.col("type_name"), F.col("inner_callable"), F.col("inner_type_name")).alias("f")).collect()}
    assert like["C.w"] == (3, True) and like["C.t"] == (2, False) and like["C.p"] == (0, False) and like["C"] == (0, False)


def test_write_docset_round_trip(spark, tmp_path):
    rows = [("m", None), ("m", "A"), ("m", "A.x"), ("m", "A.x.y"), ("m", "B"), ("n", None), ("n", "Z"), ("n", "Z.q")]
    df = spark.createDataFrame(rows, "modname string, qualname string").withColumn(
        "fields", D.object_json(F.concat(F.lit('"'), F.coalesce("qualname", "modname")).alias("name")))
    out = str(tmp_path / "out")
    D.write_docset(df.repartition(4), out)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    text = "".join(open(os.path.join(out, p)).read() for p in parts)
    assert json.loads(text) == {"modules": {
        "m": {"name": '"m', "dict": {"A": {"name": '"A', "dict": {"x": {"name": '"A.x', "dict": {
            "y": {"name": '"A.x.y'}}}}}, "B": {"name": '"B'}}},
        "n": {"name": '"n', "dict": {"Z": {"name": '"Z', "dict": {"q": {"name": '"Z.q'}}}}}}}


def test_several_sets_are_read_back(spark, tmp_path):
    rows = [(f"m{i:03}", q) for i in range(40) for q in (None, "A", "A.x", "A.x.y", "B")]
    df = spark.createDataFrame(rows, "modname string, qualname string").withColumn(
        "fields", D.object_json(F.concat("modname", F.lit(":"), F.coalesce("qualname", "modname")).alias("name")))
    folder = str(tmp_path / "sets")
    D.write_docsets(df.repartition(5), folder, 1000)
    sets = [json.loads(r.json)["modules"] for r in D.read_docsets(spark, folder).collect()]
    assert len(sets) > 5 and sorted(m for s in sets for m in s) == sorted({m for m, _ in rows})
    back = {(r.modname, r.qualname): r.name for r in D.objects(D.flatten(D.read_docsets(spark, folder))).collect()}
    assert back == {(m, q): f"{m}:{q or m}" for m, q in rows}
    one = D.read_docsets(spark, folder, "m017")
    assert len(one.inputFiles()) == 1 and "m017" in json.loads(one.first().json)["modules"]
    with pytest.raises(LookupError):
        D.read_docsets(spark, folder, "gone")


def test_cache_refresh(spark, root, tmp_path):
    folder = str(tmp_path / "cache")
    assert C.index(spark, folder).count() == 0
    first = C.refresh(spark, [root], ["pkg", "pkg.sub"], folder, "one")
    assert len(names(first)) == 7 and C.latest(spark, folder) == (1, 1)
    second = C.refresh(spark, [root], ["pkg"], folder, "two")
    # The empty helper modules have rows too, so nothing is left to do.
    assert names(second) == [] and C.latest(spark, folder) == (1, 1)
    assert set(names(C.load(spark, folder, "pkg.core"))) == {"pkg.core"}
    scan = C.index(spark, folder).filter("modname = 'pkg.core'")
    C.compact(spark, folder, scan.withColumn("size", F.col("size") + 1))
    assert C.latest(spark, folder) == (2, 2)
    left = names(C.load(spark, folder))
    assert "pkg.core" not in left and "pkg.sub.deep" in left
    assert "pkg.core" in names(C.load(spark, folder, generation=1))
    with pytest.raises(LookupError):
        C.load(spark, folder, "pkg.core")


ENTRY, PRINTED = "modname string, payload string", "modname string, version int, path string, mtime double, size bigint"


def commit(spark, folder, run, payload, mtime, *modules):
    C.commit(spark, folder, spark.createDataFrame([(m, payload) for m in modules], ENTRY),
             spark.createDataFrame([(m, 1, m + ".py", mtime, 5) for m in modules], PRINTED), run)


def test_load_gives_one_generation(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "cache")

    def loaded(**kw):
        return sorted((r.modname, r.payload) for r in C.load(spark, folder, **kw).collect())

    commit(spark, folder, "r", "old", 10.0, "a", "b")
    commit(spark, folder, "r", "new", 3.0, "a")
    assert loaded() == [("a", "new"), ("b", "old")] and loaded(generation=1) == [("a", "old"), ("b", "old")]
    assert {r.modname: r.mtime for r in C.index(spark, folder).collect()} == {"a": 3.0, "b": 10.0}
    # A run that dies before its commit leaves the old state, and the next one writes over it.
    made = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, schema=None, *a, **k: (_ for _ in ()).throw(
        RuntimeError("killed")) if schema == "base bigint" else made(rows, schema, *a, **k))
    with pytest.raises(RuntimeError):
        commit(spark, folder, "r", "lost", 20.0, "a", "c")
    monkeypatch.undo()
    assert loaded() == [("a", "new"), ("b", "old")] and C.latest(spark, folder) == (2, 1)
    commit(spark, folder, "s", "next", 20.0, "b")
    assert loaded() == [("a", "new"), ("b", "next")]


def test_streaming_refresh(spark, tmp_path):
    incoming, folder, checkpoint = (str(tmp_path / n) for n in ("in", "cache", "state"))
    schema = "modname string, version int, path string, mtime double, size bigint, source string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(incoming)
        refresh_available(spark, incoming, folder, checkpoint)
        found = {}
        for r in C.load(spark, folder).collect():
            found.setdefault(r.modname, set()).add(json.loads(r.payload).get("name"))
        return found, {r.modname: (r.mtime, r.generation) for r in C.index(spark, folder).collect()}

    one = [("a", 1, "a.py", 2.0, 5, "x = 1\n"), ("b", 1, "b.py", 1.0, 5, "def f(): pass\n")]
    assert arrive(one) == ({"a": {"a", "x"}, "b": {"b", "f"}}, {"a": (2.0, 1), "b": (1.0, 1)})
    # A late older snapshot, and one seen before, change nothing.
    late = arrive([("a", 1, "a.py", 1.0, 9, "old = 1\n"), one[1]])
    assert late == ({"a": {"a", "x"}, "b": {"b", "f"}}, {"a": (2.0, 1), "b": (1.0, 1)})
    two = [("a", 1, "a.py", 3.0, 6, "x = 1\ny = 2\n"), ("c", 1, "c.py", 1.0, 1, "")]
    after = arrive(two)
    assert after == ({"a": {"a", "x", "y"}, "b": {"b", "f"}, "c": {"c"}}, {"a": (3.0, 2), "b": (1.0, 1), "c": (1.0, 2)})
    # The same batch again, as after a failure behind the commit.
    from docloom.streaming.refresh import refresh_batch
    refresh_batch(spark.createDataFrame(two, schema), 2, folder)
    assert C.latest(spark, folder) == (2, 1)


def test_type_labels(spark):
    def label(kind, name="f", get=None, set_=None):
        row = spark.range(1).select(O.type_label(
            F.lit("builtins"), F.lit(kind), F.lit(name), F.lit(get).cast("boolean"),
            F.lit(set_).cast("boolean"), F.lit(None).cast("boolean")).alias("l")).first()
        return row.l

    assert label("property", get=True, set_=True) == "get/set property"
    assert label("function", "<lambda>") == "lambda function"
    assert label("int") is None
    assert spark.range(1).select(O.category(F.lit("builtins"), F.lit("getset_descriptor")).alias("c")).first().c == "attributes"


def test_bodies_of_every_statement_are_followed(spark):
    source = (
        "try:\n    import ujson as json\nexcept ImportError:\n    json = None\n    def fallback(): pass\n"
        "for i in range(2):\n    def looped(): pass\nwhile x:\n    y = 1\n"
        "match z:\n    case 1:\n        matched = 1\nwith open('f') as handle:\n    inside = 1\ntype Alias = int\n")
    from docloom.sources import extract
    raw = extract.parse_sources(spark.createDataFrame([("m", "p", source)], "modname string, path string, source string"))
    names = {r["name"] for r in raw.collect()}
    assert {"fallback", "looped", "i", "y", "matched", "handle", "inside", "Alias", "json"} <= names


def test_deep_sources_do_not_stop_the_run(spark):
    from docloom.sources import extract
    deep = "x = " + "-" * 3000 + "1"
    rows = spark.createDataFrame([("deep", "p", deep), ("good", "q", "def f(): pass")],
                                 "modname string, path string, source string")
    assert "f" in {r["name"] for r in extract.parse_sources(rows).collect()}


def test_a_repeated_run_keeps_its_rows(spark, tmp_path):
    from docloom.sources import cache
    root = tmp_path / "src"
    root.mkdir()
    (root / "one.py").write_text("a = 1\n")
    folder = str(tmp_path / "cache")
    for _ in range(2):
        cache.refresh(spark, [str(root)], ["one"], folder, "r1")
        assert cache.load(spark, folder).count() == 2


def test_one_malformed_document_leaves_the_others(spark):
    from docloom.sources import docset
    docs = spark.createDataFrame([('{"modules": {"m": {"type": {}}}}',), ("{broken",)], "json string")
    assert [r.modname for r in docset.flatten(docs).collect()] == ["m"]
    assert docset.bad_documents(docs).count() == 1


def test_row_wise_work_is_spread_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10, raising=False)
    assert session.spread(spark.range(1000), "id").rdd.getNumPartitions() >= 100


def test_bindings_parse_the_sources_once(spark):
    sources = spark.createDataFrame([("m", "m.py", "class C: pass\nC.x = 1\n")], "modname string, path string, source string")
    bound = E.bindings(E.parse_sources(sources))
    assert "MapInArrow" not in bound._jdf.queryExecution().executedPlan().toString()
    assert {r.qualname for r in bound.collect()} == {None, "C", "C.x"}


def test_rows_of_long_sources_are_handed_back_in_small_batches(monkeypatch):
    monkeypatch.setattr(E, "CHARS_PER_BATCH", 100, raising=False)
    rows = [{"modname": f"m{i}", "path": f"m{i}.py", "source": f'"""{"x" * 200}"""\na = {i}\n'} for i in range(5)]
    batches = list(E._parse([pa.RecordBatch.from_pylist(rows)]))
    assert [b.num_rows for b in batches] == [2] * 5
