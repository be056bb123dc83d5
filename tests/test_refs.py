from pyspark.sql import functions as F

from docloom.operators import members as M
from docloom.operators import refs as R
from docloom.operators import signatures as S

ALIAS = "modname string, member_name string, target_mod string, target_qual string"
OBJECT = "modname string, qualname string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_long_chains_and_cycles(spark):
    n = 300
    chain = [("m", f"a{i}", "m", f"a{i + 1}") for i in range(n)]
    loop = [("m", "x", "m", "y"), ("m", "y", "m", "x"), ("m", "z", "m", "y"), ("m", "s", "m", "s")]
    module = [("m", "mod", "other", None), ("m", "via", "m", "mod")]
    got = {r.member_name: r for r in R.resolve_aliases(
        spark.createDataFrame(chain + loop + module, ALIAS), with_path=True).collect()}
    assert len(got) == n + 6
    assert (got["a0"].final_qual, got["a0"].hops, got["a0"].is_cycle) == (f"a{n}", n, False)
    assert got["a0"].path == [f"m.a{i}" for i in range(1, n + 1)]
    assert all(got[k].is_cycle and got[k].hops is None for k in "xyzs")
    assert (got["via"].final_mod, got["via"].final_qual, got["via"].hops) == ("other", None, 2)


def test_resolving_twice_changes_nothing(spark):
    edges = spark.createDataFrame([("m", "a", "m", "b"), ("m", "b", "n", "C")], ALIAS)
    once = R.resolve_aliases(edges).select(
        "modname", "member_name", F.col("final_mod").alias("target_mod"),
        F.col("final_qual").alias("target_qual"))
    twice = R.resolve_aliases(once)
    assert rows(twice, "member_name", "final_mod", "final_qual") == [("a", "n", "C"), ("b", "n", "C")]


def test_names(spark):
    objects = spark.createDataFrame([
        ("html", None), ("html.parser", None), ("html.parser", "HTMLParser"),
        ("html.parser", "HTMLParser.close"), ("html", "parser.x"), ("builtins", "len"),
        ("len", None), ("html", "parser")], OBJECT)
    names = ["html.parser.HTMLParser.close", "len", "html:", "html:parser", "html.parser.x", "html.parser",
             "nope", "html.parser:HTMLParser.gone"]
    got = R.resolve_names(spark.createDataFrame([(n,) for n in names], "name string"), objects)
    assert {r.name: (r.modname, r.qualname) for r in got.collect()} == {
        "html.parser.HTMLParser.close": ("html.parser", "HTMLParser.close"),
        "len": ("len", None), "html:": ("html", None), "html:parser": ("html", "parser"),
        "html.parser.x": ("html", "parser.x"), "html.parser": ("html.parser", None),
        "nope": (None, None), "html.parser:HTMLParser.gone": (None, None)}


def test_lookup_through_imports(spark):
    objects = spark.createDataFrame(
        [("m", None), ("n", None), ("n", "C"), ("n", "C.f")], OBJECT)
    aliases = spark.createDataFrame(
        [("m", "nn", "n", None), ("m", "D", "m", "E"), ("m", "E", "n", "C"), ("m", "bad", "n", "Z")], ALIAS)
    asked = spark.createDataFrame(
        [("m", "nn.C.f"), ("m", "D.f"), ("m", "D.g"), ("m", "bad.x"), ("m", None), ("q", "x")], OBJECT)
    got = R.look_up_through(asked, objects, aliases)
    assert {(r.modname, r.qualname): (r.status, r.found_mod, r.found_qual, r.missing_name)
            for r in got.collect()} == {
        ("m", "nn.C.f"): ("found", "n", "C.f", None), ("m", "D.f"): ("found", "n", "C.f", None),
        ("m", "D.g"): ("missing_name", None, None, "D.g"),
        ("m", "bad.x"): ("missing_name", None, None, "bad"),
        ("m", None): ("found", "m", None, None), ("q", "x"): ("missing_module", None, None, None)}


def test_closure_with_a_loop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "child string, base string")
    got = {(r.child, r.ancestor): r.depth for r in R.ancestor_closure(edges).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("a", "a"): 2, ("b", "c"): 1, ("b", "a"): 2,
                   ("b", "b"): 3, ("c", "a"): 1, ("c", "b"): 2, ("c", "c"): 2}


def test_visibility(spark):
    parents = spark.createDataFrame(
        [("listed", None, "module", True, ["foo", "Master", "Child"]), ("null", None, "module", True, None),
         ("absent", None, "module", False, None), ("t", "C", "type", False, None)],
        "modname string, qualname string, type_name string, has_all_names boolean, all_names array<string>")
    names = {("listed", None): ["foo", "_bar", "Master", "Child", "logging"], ("null", None): ["foo", "_bar"],
             ("absent", None): ["foo", "_bar", "__x__"], ("t", "C"): ["m", "_p", "__init__", "_C__q"]}
    members = spark.createDataFrame(
        [(m, q, n, n == "logging") for (m, q), ns in names.items() for n in ns],
        "parent_mod string, parent_qual string, member_name string, is_ref boolean")

    def shown(**kw):
        out = {}
        for r in M.visible(members, parents, **kw).collect():
            out.setdefault(r.parent_mod, set()).add(r.member_name)
        return out

    assert shown() == {"listed": {"foo", "Master", "Child"}, "null": {"foo", "_bar"},
                       "absent": {"foo"}, "t": {"m", "__init__"}}
    assert shown(strict=True)["null"] == {"foo"}
    assert "logging" not in shown(private=True, imports=False)["listed"]


def test_tags_meet_signature(spark):
    params = spark.createDataFrame([("f", 1, "x", "K"), ("f", 2, "y", "K")], "obj string, pos bigint, name string, kind string")
    found = [("param", "x", "a"), ("param", "x", "b"), ("type", "y", "t"), ("param", "zz", "c"),
             ("return", None, "r1"), ("return", None, "r2"), ("raise", "E", "m")]
    tags = spark.createDataFrame(
        [("f", i, *t) for i, t in enumerate(found)], "obj string, pos bigint, tag string, arg string, text string")
    assert rows(S.attach_to_params(params, tags), "name", "doc", "doc_type") == [("x", "b", None), ("y", None, "t")]
    assert rows(S.unmatched_tags(params, tags), "arg") == [("zz",)]
    assert rows(S.attach_returns(tags), "doc", "doc_type") == [("r2", None)]
    assert rows(S.exceptions(tags), "exc_type", "doc") == [("E", "m")]


def test_signature_texts(spark):
    def kinds(*pairs):
        return [("f", i, n, k) for i, (n, k) in enumerate(pairs, 1)]

    p, ko, vp, vk = "POSITIONAL_OR_KEYWORD", "KEYWORD_ONLY", "VAR_POSITIONAL", "VAR_KEYWORD"
    schema = "obj string, pos bigint, name string, kind string"
    one = spark.createDataFrame(kinds(("x", p), ("y", p), ("w", ko), ("kw", vk)), schema)
    two = spark.createDataFrame(kinds(("x", p), ("a", vp), ("fn", ko), ("kw", vk)), schema)
    assert S.signature_texts(one).first().signature == "(x, y, *, w, **kw)"
    assert S.signature_texts(two).first().signature == "(x, *a, fn, **kw)"
    assert spark.range(1).select(S.signature_text(
        F.lit(None).cast("array<struct<pos:bigint,name:string,kind:string>>")).alias("s")).first().s == "(⁇)"


def test_signature_tags_are_parsed_not_run(spark):
    objects = spark.createDataFrame([("f", True), ("g", True), ("h", True), ("v", False)], "obj string, callable boolean")
    params = spark.createDataFrame([("g", "x")], "obj string, name string")
    tags = spark.createDataFrame(
        [("f", 1, "signature", "f(a, /, b: int = 3, *c, d=None, **e) -> str"), ("f", 2, "signature", "f(z)"),
         ("g", 1, "signature", "g(q)"), ("h", 1, "signature", "h(x=1/0"), ("v", 1, "signature", "v(x)")],
        "obj string, pos bigint, tag string, text string")
    chosen = S.signature_tags(objects, tags, params)
    got = rows(S.parsed_params(chosen), "pos", "name", "kind", "default_repr", "annotation")
    assert got == [
        (1, "a", "POSITIONAL_ONLY", None, None), (2, "b", "POSITIONAL_OR_KEYWORD", "3", "int"),
        (3, "c", "VAR_POSITIONAL", None, None), (4, "d", "KEYWORD_ONLY", "None", None),
        (5, "e", "VAR_KEYWORD", None, None)]


REF = "modname string, qualname string, target_mod string, target_qual string"


def brute_ref(refs, mod, qual, limit=400):
    """(end, hops) by replacing the first prefix that is a ref, over and over."""
    hops = 0
    while hops < limit:
        parts = qual.split(".") if qual else []
        for i in range(1, len(parts) + 1):
            hit = refs.get((mod, ".".join(parts[:i])))
            if hit:
                mod, qual = hit[0], ".".join([*(hit[1].split(".") if hit[1] else []), *parts[i:]])
                hops += 1
                break
        else:
            return (mod, qual or None), hops
    return None, None


def test_refs_at_any_depth_equal_brute_force(spark):
    import random
    r = random.Random(4)
    for _ in range(1):
        refs = {}
        for i in range(120):
            place = ".".join(r.choice("abcd") + str(r.randrange(9)) for _ in range(r.choice([1, 1, 2, 3])))
            # No ref below another ref: a walk never comes there.
            ups = [place[:k] for k in range(len(place)) if place[k] == "."]
            mod = r.choice("mn")
            if any((mod, u) in refs for u in ups) or any(m == mod and q.startswith(place + ".") for m, q in refs):
                continue
            qual = ".".join(r.choice("abcd") + str(r.randrange(9)) for _ in range(r.choice([0, 1, 1, 2, 3])))
            refs[mod, place] = (r.choice("mn"), qual or None)
        df = spark.createDataFrame([(*k, *v) for k, v in refs.items()], REF)
        got = {(x.modname, x.qualname): x for x in R.resolve_refs(df, with_path=True).collect()}
        assert len(got) == len(refs)
        for key in refs:
            end, hops = brute_ref(refs, *key)
            x = got[key]
            assert (((x.final_mod, x.final_qual) if end else None), x.hops, x.is_cycle) == (end, hops, end is None), key
            if end:
                assert x.path[-1] == ".".join(filter(None, end)) and len(x.path) == hops


def test_a_name_through_many_class_refs(spark):
    n = 30
    objects = [("m", None), ("m", "x"), *[(f"k{i}", None) for i in range(n + 1)], *[(f"k{i}", "C") for i in range(n + 1)]]
    aliases = [("m", "p0", "k0", "C"), *[(f"k{i}", f"C.p{i + 1}", f"k{i + 1}", "C") for i in range(n)]]
    nested = ".".join(f"q{i}" for i in range(30))
    objects += [(f"k{n}", "C." + ".".join(nested.split(".")[:i])) for i in range(1, 31)]
    # One ref reaches the end of the line through all others.
    aliases.append(("m", "far", "m", ".".join(f"p{i}" for i in range(n + 1))))
    asked = [("m", "far." + nested), ("m", "far.q0.nope.q2"), ("m", "p0.p1.p2"), ("m", "p0.p1.zz.p3"), ("m", "x.y")]
    got = R.look_up_through(spark.createDataFrame(asked, OBJECT), spark.createDataFrame(objects, OBJECT),
                            spark.createDataFrame(aliases, ALIAS))
    assert {r.qualname: (r.status, r.found_mod, r.found_qual, r.missing_name) for r in got.collect()} == {
        "far." + nested: ("found", f"k{n}", "C." + nested, None),
        "far.q0.nope.q2": ("missing_name", None, None, "far.q0.nope"), "p0.p1.p2": ("found", "k2", "C", None),
        "p0.p1.zz.p3": ("missing_name", None, None, "p0.p1.zz"), "x.y": ("missing_name", None, None, "x.y")}


def test_closure_equals_brute_force(spark):
    import random
    r = random.Random(8)
    edges = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(70)} | {(f"l{i}", f"l{i + 1}") for i in range(50)}
    want = {}
    for start in {a for a, _ in edges}:
        depth, layer, seen = 1, {b for a, b in edges if a == start}, set()
        while layer:
            want.update({(start, x): depth for x in layer})
            seen |= layer
            layer = {b for a, b in edges if a in layer} - seen
            depth += 1
    got = R.ancestor_closure(spark.createDataFrame(sorted(edges), "child string, base string")).collect()
    assert {(x.child, x.ancestor): x.depth for x in got} == want


def test_closure_pairs_travel_as_arrays(spark):
    edges = [(f"d{i}", f"d{i // k}") for i in range(1, 300) for k in (2, 3)] + [("d7", None), (None, "d1")]
    got = R.ancestor_closure(spark.createDataFrame(edges, "child string, base string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Nothing is copied to a checkpoint, and pairs are not shuffled one by one.
    assert "ExistingRDD" not in plan and "Exchange hashpartitioning(child" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "ancestor" in line]
    rows = {(r.child, r.ancestor): r.depth for r in got.collect()}
    assert rows[("d7", None)] == 1 and rows[(None, "d1")] == 1 and rows[("d255", "d1")] == 5 and rows[("d299", "d0")] == 6


def test_orders_equal_those_of_python(spark):
    import random
    r = random.Random(5)
    classes, edges, bad = {"object": object}, [], {}
    for i in range(60):
        picked = r.sample(list(classes), min(len(classes), r.choice([1, 1, 2, 3])))
        name = f"C{i}"
        try:
            classes[name] = type(name, tuple(classes[p] for p in picked), {})
            edges += [(name, k, p) for k, p in enumerate(picked)]
        except TypeError:
            bad[name] = None
            edges += [(name, k, p) for k, p in enumerate(picked)] + [(name + "x", 0, name)]
            bad[name + "x"] = None
    edges += [("L1", 0, "L2"), ("L2", 0, "L1")]
    got = {x.child: x.mro for x in R.linearize(spark.createDataFrame(edges, "child string, pos int, base string")).collect()}
    want = {n: [k.__name__ for k in c.__mro__] for n, c in classes.items()} | bad | {"L1": None, "L2": None}
    assert bad and got == want


def test_tags_of_one_kind_need_one_branch(spark, tmp_path):
    from docloom.plans.tables import Tables
    spark.createDataFrame([(1, 1), (6, 1), (6, 2), (6, 3), (6, 4)], "l_orderkey long, l_linenumber int").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    tags = Tables(spark, str(tmp_path)).tags()
    raised = tags.filter("tag = 'raise'")
    plan = raised._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Generate explode") == 2
    assert [tuple(r) for r in raised.collect()] == [("f6", 5000003, "raise", "Error3", "when p3")]
    assert sorted(tuple(r) for r in tags.filter("obj = 'f6' AND tag IN ('param', 'rtype')").collect()) == [
        ("f6", 1, "param", "p1", "about p1"), ("f6", 3, "param", "p3", "about p3"), ("f6", 1000003, "param", "p3", "again p3"),
        ("f6", 2000004, "param", "zz", "lost p4"), ("f6", 4000002, "rtype", None, "kind p2")]
