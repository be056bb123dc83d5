"""Bindings of source texts, and from sources to pages."""

import json

import pytest

from docloom.operators import refs as R
from docloom.sources import corpus as K
from docloom.sources import extract as E

SOURCE = "modname string, path string, source string"


def bound(spark, text):
    raw = E.parse_sources(spark.createDataFrame([("m", "m.py", text)], SOURCE))
    return {r.qualname: r for r in E.bindings(raw).collect()}, E.exports(raw).collect()


def test_the_last_binding_counts(spark):
    got, listed = bound(spark, """
import a
a = 1
b, (c, *d) = lambda x: x, (1, 2, 3)
e, f = lambda y: y, "s"
try:
    import fast as g
except ImportError:
    g = None
    only = 2
if __name__ == "__main__":
    never = 1
if False: no = 1
else: yes = 1
del f
for h, i in []: pass
with open(x) as j: pass
match x:
    case {"k": k, **l}: m = 1
if (n := 3): pass
o: int
p: int = 4
__all__ = [*("a",), "b"]
__all__ += ["c"]
__all__.extend(("d", "a"))
__all__.remove("a")
__all__.append("z")
class _K:
    __q = 1
    def __r__(self): pass
    @property
    def s(self): "S."
    @s.setter
    def s(self, v): pass
    t = property(fget=None, fset=lambda self, v: None, doc="T.")
    u = staticmethod(lambda w: w)
    @Other.v.setter
    def v(self, x): pass
    s2 = s
_K.x = 5
_K.y.z = 6
nowhere.x = 7
""")
    kinds = {q: r.kind for q, r in got.items()}
    assert kinds == {
        None: "module", "a": "value", "b": "function", "c": "value", "d": "value", "e": "function", "g": "import",
        "only": "value", "yes": "value", "h": "value", "i": "value", "j": "value", "k": "value", "l": "value",
        "m": "value", "n": "value", "p": "value", "__all__": "value", "_K": "type", "_K._K__q": "value",
        "_K.__r__": "function", "_K.s": "property", "_K.t": "property", "_K.u": "staticmethod", "_K.v": "property",
        "_K.s2": "value", "_K.x": "value"}
    assert listed[0].all_names == ["b", "c", "d", "a", "z"]
    assert got["e"].name == "<lambda>" and got["p"].value_type == "int"

    def has(q):
        return got[q].has_get, got[q].has_set, got[q].has_del

    assert has("_K.s") == (True, True, False) and has("_K.t") == (False, True, False) and has("_K.v") == (False, True, False)
    assert got["_K.s"].doc == "S." and got["_K.t"].doc == "T." and got["_K.u"].signature.params[0].name == "w"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {
        "app": "from .shapes import Square as Sq, area\nfrom .shapes import *\n",
        "app.base": ('"""Bases."""\nclass Shape:\n    "A shape."\n    def size(self) -> float: "How large."\n    sides = 0\n'
                     "    alias = size\nfactor = 2\n"),
        "app.shapes": (
            "import app.base as b, other.lib as lib\n__all__ = ['Square', 'area']\nclass Square(b.Shape, lib.Mixin, make()):\n"
            "    class Part: pass\n    part = Part()\n    size = b.Shape.alias\n    def get(self, p: Part, q: 'x'): 'Gets.'\n"
            "    prop = property(get)\n    st = staticmethod(b.Shape.size)\narea = Square.size\nscale = b.factor\n"
            "handle = lib.open\nlist2 = list()\n"),
        "app.bad": "def x(:",
    }
    sources = spark.createDataFrame([(m, m.replace(".", "/") + ".py", t) for m, t in texts.items()], SOURCE)
    return K.build(sources, spark.createDataFrame([("app",)], "modname string"))


def test_names_are_resolved_in_their_scopes(corpus):
    refs = {(r.modname, r.qualname): (r.target_mod, r.target_qual) for r in corpus.refs.collect()}
    assert refs == {
        ("app", "Sq"): ("app.shapes", "Square"), ("app", "Square"): ("app.shapes", "Square"), ("app", "area"): ("app.shapes", "area"),
        ("app.base", "Shape.alias"): ("app.base", "Shape.size"), ("app.shapes", "b"): ("app.base", None),
        ("app.shapes", "lib"): ("other.lib", None), ("app.shapes", "Square.size"): ("app.base", "Shape.alias"),
        ("app.shapes", "area"): ("app.shapes", "Square.size"), ("app.shapes", "handle"): ("other.lib", "open")}
    bases = sorted((r.pos, r.base_mod, r.base_qual) for r in corpus.bases.collect())
    assert bases == [(0, "app.base", "Shape"), (1, "other.lib", "Mixin")]
    told = [(r.qualname, r.pos, r.target_mod, r.target_qual) for r in corpus.annotations.collect()]
    assert told == [("Square.get", 2, "app.shapes", "Square.Part")]
    objects = {(r.modname, r.qualname): r for r in corpus.objects.collect()}
    kind = lambda m, q: (objects[m, q].type_mod, objects[m, q].type_qual)
    assert kind("app.shapes", "Square.part") == ("app.shapes", "Square.Part")
    assert kind("app.shapes", "scale") == ("builtins", "int") and kind("app.shapes", "list2") == ("builtins", "list")
    assert objects["app.shapes", "Square.prop"].doc == "Gets." and objects["app.shapes", "Square.prop"].has_get
    assert objects["app.shapes", "Square.st"].doc == "How large." and objects["app.shapes", "Square.st"].params[0].name == "self"
    assert objects["app.shapes", None].all_names == ["Square", "area"] and objects["app", None].has_all_names is False
    assert [r.modname for r in corpus.failed.collect()] == ["app.bad"]
    shown = {(r.parent_mod, r.parent_qual, r.member_name): r.exported for r in corpus.members.collect()}
    assert shown["app.shapes", None, "area"] is True and shown["app.shapes", None, "b"] is False
    assert shown["app.shapes", "Square", "size"] is None


def test_pages_from_sources(spark, corpus):
    rows = K.pages(corpus).cache()
    page = {(r.section, r.key): json.loads(r.json) for r in rows.filter("modname = 'app.shapes' AND qualname = 'Square'").collect()}
    assert page[8, "size"] == {"plain_name": "size", "signature": "(self)", "type_label": "function",
                               "import_path": "app.base.Shape.alias", "summary": "How large.", "has_more": False}
    assert page[7, "prop"]["type_label"] == "get property" and page[9, "part"]["type_label"] == "Part"
    one = K.pages_of(spark.createDataFrame([("app.area",), ("app.Sq",), ("gone",)], "name string"), corpus, rows)
    heads = {r.name: (r.modname, r.qualname) for r in one.filter("section = 0").collect()}
    assert heads == {"app.area": ("app.base", "Shape.size"), "app.Sq": ("app.shapes", "Square")}


def test_every_set_of_refs_is_followed_once(spark, monkeypatch):
    followed = []
    follow = R.resolve_refs
    monkeypatch.setattr(R, "resolve_refs", lambda *a, **k: followed.append(a) or follow(*a, **k))
    sources = spark.createDataFrame(
        [("p", "p.py", "class A:\n    def f(self): 'F.'\nrun = A.f\n"), ("q", "q.py", "from p import A as B, run\ngo = B.f\n")],
        "modname string, path string, source string")
    got = {(r.modname, r.key): json.loads(r.json) for r in K.pages(K.build(sources)).filter("section > 4").collect()}
    # The imports, then these with assigned names, then what of them stays a ref.
    assert len(followed) == 3
    assert got["q", "go"]["summary"] == got["q", "run"]["summary"] == got["p", "run"]["summary"] == "F."
    assert got["q", "go"]["import_path"] == "p.A.f" and got["p", "f"]["type_label"] == "function"
