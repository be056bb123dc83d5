"""Queries with the readers, the source inventory, extraction and the cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.operators import signatures as S
from docloom.plans.registry import query
from docloom.plans.tables import with_views
from docloom.session import durable, shared_folder, spread
from docloom.sources import cache as C
from docloom.sources import docset as D
from docloom.sources import extract as E
from docloom.sources import inventory as V

col = F.col


def _sym_documents(t):
    """One small documentation set per symbol: the object inside its parents."""
    def obj(name, type_qual, inner=None):
        fields = [
            F.lit('{"name": "'), name, F.lit('", "type": {"$ref": "#/modules/builtins/dict/'), type_qual,
            F.lit('"}, "type_name": "'), type_qual, F.lit('"')]
        if inner is not None:
            fields += [F.lit(', "dict": '), inner]
        return F.concat(*fields, F.lit("}"))

    def entry(key, value):
        return F.concat(F.lit('{"'), key, F.lit('": '), value, F.lit("}"))

    own = obj(col("name"), col("type_qual"))
    top = F.coalesce("parent_qual", "qualname")
    in_class = F.when(
        col("parent_qual").isNull(), own
    ).otherwise(obj(top, F.lit("type"), entry(col("name"), own)))
    module = F.when(col("qualname").isNull(), own).otherwise(
        obj(col("modname"), F.lit("module"), entry(top, in_class)))
    return t.sym().select(
        F.concat(F.lit('{"modules": '), entry(col("modname"), module), F.lit("}")).alias("json"))


@query("a01_read_docset", with_views("sym") + " SELECT DISTINCT modname, qualname, name, 'builtins' AS type_mod, type_qual, type_qual AS type_name FROM sym")
def read_docset(t):
    nodes = D.flatten(_sym_documents(t))
    return D.objects(nodes).select(
        "modname", "qualname", "name", "type_mod", "type_qual", "type_name").distinct()


@query("a01_docset_members", with_views("sym", "imports") + """ SELECT DISTINCT modname AS parent_mod, parent_qual, name AS member_name, false AS is_ref, modname AS target_mod, qualname AS target_qual
FROM sym WHERE qualname IS NOT NULL UNION ALL SELECT modname, NULL, member_name, true, target_mod, target_qual FROM imports""")
def docset_members(t):
    ref = N.make_ref(col("target_mod"), col("target_qual"))
    aliases = t.imports().select(F.concat(
        F.lit('{"modules": {"'), "modname", F.lit('": {"dict": {"'), "member_name",
        F.lit('": {"$ref": "'), ref, F.lit('"}}}}}')).alias("json"))
    nodes = D.flatten(_sym_documents(t).union(aliases))
    return D.members(nodes).drop("exported").distinct()


@query("a02_write_docset", with_views("sym") + """, o AS (SELECT modname, qualname, name, type_qual,
  coalesce(string_split(qualname, '.'), []) AS p FROM sym),
n AS (SELECT *, row_number() OVER w - 1 AS pos, len(p) AS d, lead(len(p)) OVER w AS nd FROM o WINDOW w AS (ORDER BY modname, p))
SELECT pos, CASE WHEN pos = 0 THEN '{"modules": {' ELSE '' END || '"' || coalesce(p[-1], modname) || '": {"name":"' || name || '","type_name":"' || type_qual || '"' ||
CASE WHEN nd > d THEN ', "dict": {' ELSE '}' || repeat('}}', CAST(CASE WHEN nd IS NULL THEN d ELSE d - nd END AS INTEGER)) || CASE WHEN nd IS NULL THEN '}}' ELSE ',' END END AS line FROM n""")
def write_docset(t):
    rows = t.sym().select(
        "modname", "qualname",
        D.object_json(col("name"), col("type_qual").alias("type_name")).alias("fields"))
    return D.docset_lines(rows)


@query("a02_sets_round_trip", with_views("sym") + """ SELECT modname, qualname, name, type_qual AS type_name, count(*) OVER (PARTITION BY modname) AS found FROM sym""")
def sets_round_trip(t):
    """Sets of two modules or so written, read back whole, and counted by reading a module's set only."""
    spark, folder = t.spark, shared_folder(t.spark, "sets")
    fields = D.object_json(col("name"), col("type_qual").alias("type_name"))
    rows = t.sym().select("modname", "qualname", fields.alias("fields"))
    size = rows.agg(F.sum(F.length("fields")).alias("n")).first().n // 2
    D.write_docsets(rows, folder, size)
    back = D.objects(D.flatten(D.read_docsets(spark, folder))).select("modname", "qualname", "name", "type_name")
    # Region modules are few and fixed in number.
    names = [r.modname for r in t.sym().filter("qualname IS NULL").select("modname").collect()]
    single = reduce(DataFrame.unionByName, [
        D.objects(D.flatten(D.read_docsets(spark, folder, m))).filter(col("modname") == m).groupBy("modname").agg(
            F.count("*").alias("found")) for m in names])
    return back.join(single, "modname")


@query("a03_object_json", with_views("sym") + """ SELECT concat_ws('.', modname, qualname) AS full_name,
'{"modname":"' || modname || CASE WHEN qualname IS NULL THEN '' ELSE '","qualname":"' || qualname END || '","name":"' || name || '","type_qual":"' || type_qual || '"}' AS json FROM sym""")
def object_json(t):
    return t.sym().select(
        N.full_name(col("modname"), col("qualname")).alias("full_name"),
        D.object_json("modname", "qualname", "name", "type_qual").alias("json"))


# Page addresses as source files; a folder is a package unless its path length divides by seven.
FILES_SQL = """WITH leaf AS (SELECT DISTINCT regexp_replace(regexp_replace(replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '.', '/'), '[^A-Za-z0-9/]', '', 'g'), '/+$', '') AS p FROM pages),
folder AS (SELECT DISTINCT array_to_string(s[:i], '/') AS f FROM (SELECT s, unnest(range(1, len(s))) AS i FROM (SELECT string_split(p, '/') AS s FROM leaf))),
pkg AS (SELECT f FROM folder WHERE length(f) % 7 <> 0),
good AS (SELECT f FROM (SELECT f, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT f, string_split(f, '/') AS s FROM pkg))
  GROUP BY f HAVING bool_and(array_to_string(s[:i], '/') IN (SELECT f FROM pkg))),
names AS (SELECT replace(f, '/', '.') AS modname, true AS is_package FROM good
  UNION ALL SELECT replace(p, '/', '.'), false FROM leaf WHERE strpos(p, '/') = 0 OR regexp_replace(p, '/[^/]*$', '') IN (SELECT f FROM good))"""


def _files(t, root="/src"):
    address = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    clean = F.regexp_replace(F.replace(address, F.lit("."), F.lit("/")), "[^A-Za-z0-9/]", "")
    leaf = t.read("pages").select(F.regexp_replace(clean, "/+$", "").alias("p")).distinct()
    pieces = F.split("p", "/")
    parents = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda i: i < F.size(pieces)),
        lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"))
    folders = leaf.select(F.explode(parents).alias("f")).distinct().filter(F.length("f") % 7 != 0)
    path = folders.select(F.concat("f", F.lit("/__init__.py")).alias("path")).union(
        leaf.select(F.concat("p", F.lit(".py"))))
    return path.select(F.lit(root).alias("root"), "path")


@query("a04_discover_modules", FILES_SQL + " SELECT modname, is_package FROM names")
def discover_modules(t):
    return V.modules(_files(t)).select("modname", "is_package")


@query("a05_modules_by_top", FILES_SQL + """ SELECT string_split(modname, '.')[1] AS top, CAST(count(*) AS BIGINT) AS n FROM names GROUP BY 1""")
def modules_by_top(t):
    return V.modules(_files(t)).groupBy(
        F.substring_index("modname", ".", 1).alias("top")).agg(F.count("*").alias("n"))


@query("a06_standard_modules", FILES_SQL + " SELECT modname FROM names WHERE strpos(replace(modname, 'thre', 'test'), 'test') = 0")
def standard_modules(t):
    # Some page names are given the word the filter looks for.
    tested = V.modules(_files(t)).select("modname", F.replace("modname", F.lit("thre"), F.lit("test")).alias("as_test"))
    kept = V.standard_modules(tested.select(col("as_test").alias("modname"), col("modname").alias("was")))
    return kept.select(col("was").alias("modname"))


@query("a07_modules_in_roots", FILES_SQL + """ SELECT root, modname FROM names, (VALUES ('/src'), ('/site')) r(root)""")
def modules_in_roots(t):
    every = _files(t).union(_files(t, "/site")).union(_files(t, "/usr/lib"))
    return V.modules(V.usable_roots(every, "/usr")).select("root", "modname")


@query("a08_submodules", FILES_SQL + " SELECT modname FROM names WHERE modname = 'blog' OR starts_with(modname, 'blog.')")
def submodules(t):
    return V.submodules(V.modules(_files(t)), "blog").select("modname")


def _sources(t):
    """A small module around every document; German ones do not parse."""
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    n, i = col("n_chars").cast("string"), col("doc_id").cast("string")
    source = F.concat(
        F.lit("import os.path as osp\nfrom pkg.base import Thing as T"), i,
        F.lit('\n__all__ = ("run", "Box'), i, F.lit('")\ndef run(x, y: int = '), n,
        F.lit(', *args, key=None, **kw) -> str:\n    """'), escaped, F.lit('"""\nclass Box'), i,
        F.lit("(T"), i, F.lit("):\n    size = "), n,
        F.lit("\n    @property\n    def value(self): return 1\n    @staticmethod\n    def make(a, /, b=2): pass\n"),
        F.when(col("lang") == "de", F.lit("def broken(:\n")).otherwise(""))
    return spread(t.read("documents"), "doc_id").select(
        F.concat(F.lit("docs.m"), i).alias("modname"), F.concat(F.lit("docs/m"), i, F.lit(".py")).alias("path"),
        source.alias("source"))


EXTRACT_SQL = """SELECT 'docs.m' || doc_id AS modname, q AS qualname, k AS kind, CAST(s + CASE WHEN after THEN len(string_split(text, chr(10))) - 1 ELSE 0 END AS BIGINT) AS line_start,
CASE WHEN k = 'function' THEN text END AS doc, tgt AS target, v AS value, names FROM (
SELECT d.doc_id, d.text, unnest([{'q': NULL, 'k': 'module', 's': 0, 'after': false, 'tgt': NULL, 'v': NULL, 'names': NULL},
  {'q': 'osp', 'k': 'import', 's': 0, 'after': false, 'tgt': 'os.path', 'v': NULL, 'names': NULL},
  {'q': 'T' || doc_id, 'k': 'import', 's': 1, 'after': false, 'tgt': 'pkg.base:Thing', 'v': NULL, 'names': NULL},
  {'q': '__all__', 'k': 'value', 's': 2, 'after': false, 'tgt': NULL, 'v': '(''run'', ''Box' || doc_id || ''')', 'names': 'run,Box' || doc_id},
  {'q': 'run', 'k': 'function', 's': 3, 'after': false, 'tgt': NULL, 'v': NULL, 'names': NULL},
  {'q': 'Box' || doc_id, 'k': 'type', 's': 5, 'after': true, 'tgt': NULL, 'v': NULL, 'names': NULL},
  {'q': 'Box' || doc_id || '.size', 'k': 'value', 's': 6, 'after': true, 'tgt': NULL, 'v': CAST(n_chars AS VARCHAR), 'names': NULL},
  {'q': 'Box' || doc_id || '.value', 'k': 'property', 's': 7, 'after': true, 'tgt': NULL, 'v': NULL, 'names': NULL},
  {'q': 'Box' || doc_id || '.make', 'k': 'staticmethod', 's': 9, 'after': true, 'tgt': NULL, 'v': NULL, 'names': NULL}], recursive := true)
FROM documents d WHERE lang <> 'de')"""


@query("a09_extract_objects", EXTRACT_SQL)
def extract_objects(t):
    good, _ = E.split_errors(E.parse_sources(_sources(t)))
    return good.select(
        "modname", "qualname", "kind", "line_start", "doc", "target", "value",
        F.array_join("all_names", ",").alias("names"))


@query("a09_import_edges", """SELECT 'docs.m' || doc_id AS modname, 'osp' AS member_name, 'os.path' AS target_mod, CAST(NULL AS VARCHAR) AS target_qual FROM documents WHERE lang <> 'de'
UNION ALL SELECT 'docs.m' || doc_id, 'T' || doc_id, 'pkg.base', 'Thing' FROM documents WHERE lang <> 'de'""")
def extract_imports(t):
    return E.aliases(E.parse_sources(_sources(t)))


def _bound_sources(t):
    """A module around every document that binds its names in many ways."""
    n, i = col("n_chars").cast("string"), col("doc_id").cast("string")
    source = F.concat(
        F.lit("from pkg.base import helper as h\n__all__ = ['run'] + [\"T"), i, F.lit('"]\nrun = None\ndef run(x, y: int = '), n,
        F.lit('):\n    "Runs."\nclass C'), i, F.lit("(h, metaclass=type):\n    def __p(self, k="), i,
        F.lit('): "Private."\n    def q(self, v): pass\n    data = property(__p, q)\n    @data.deleter\n    def data(self): pass\n'
              "    gone = 1\n    del gone\nC"), i,
        F.lit(".extra = lambda z, *w: z\nh.lost = 1\ntry:\n    T"), i, F.lit(" = ["), n, F.lit("]\nexcept NameError:\n    T"), i,
        F.lit(" = None\nif (size := "), n, F.lit(") > 3: pass\n__all__ += ('size',)\n__all__.remove('run')\n"))
    return spread(t.read("documents"), "doc_id").select(
        F.concat(F.lit("b.m"), i).alias("modname"), F.concat(F.lit("b/m"), i, F.lit(".py")).alias("path"), source.alias("source"))


@query("a09_bindings", """SELECT 'b.m' || doc_id AS modname, r.q AS qualname, r.t AS type_name, CAST(r.s AS BIGINT) AS line_start, CAST(r.e AS BIGINT) AS line_end,
r.p AS params, r.b AS bases, r.d AS doc, r.n AS names, r.a AS accessors FROM (SELECT doc_id, unnest([
  {'q': NULL, 't': 'module', 's': 0, 'e': 22, 'p': NULL, 'b': NULL, 'd': NULL, 'n': 'T' || doc_id || ',size', 'a': ''},
  {'q': 'run', 't': 'function', 's': 3, 'e': 5, 'p': 'x,y:int=' || n_chars, 'b': NULL, 'd': 'Runs.', 'n': NULL, 'a': ''},
  {'q': 'C' || doc_id, 't': 'type', 's': 5, 'e': 13, 'p': NULL, 'b': 'h', 'd': NULL, 'n': NULL, 'a': ''},
  {'q': 'C' || doc_id || '._C' || doc_id || '__p', 't': 'function', 's': 6, 'e': 7, 'p': 'self,k=' || doc_id, 'b': NULL, 'd': 'Private.', 'n': NULL, 'a': ''},
  {'q': 'C' || doc_id || '.q', 't': 'function', 's': 7, 'e': 8, 'p': 'self,v', 'b': NULL, 'd': NULL, 'n': NULL, 'a': ''},
  {'q': 'C' || doc_id || '.data', 't': 'property', 's': 8, 'e': 9, 'p': NULL, 'b': NULL, 'd': NULL, 'n': NULL, 'a': 'get,set,del'},
  {'q': 'C' || doc_id || '.extra', 't': 'function', 's': 13, 'e': 14, 'p': 'z,w', 'b': NULL, 'd': NULL, 'n': NULL, 'a': ''},
  {'q': 'T' || doc_id, 't': 'list', 's': 16, 'e': 17, 'p': NULL, 'b': NULL, 'd': NULL, 'n': NULL, 'a': ''},
  {'q': 'size', 't': 'int', 's': 19, 'e': 20, 'p': NULL, 'b': NULL, 'd': NULL, 'n': NULL, 'a': ''}]) AS r FROM documents)""")
def bindings(t):
    raw = durable(E.parse_sources(_bound_sources(t)))
    shown = F.transform("signature.params", lambda p: F.concat(
        p["name"], F.coalesce(F.concat(F.lit(":"), p["annotation"]), F.lit("")),
        F.coalesce(F.concat(F.lit("="), p["default_repr"]), F.lit(""))))
    listed = E.exports(raw).withColumn("qualname", F.lit(None).cast("string"))
    objects = E.objects(raw).filter("qualname IS NULL OR qualname <> '__all__'").alias("o").join(
        listed.alias("l"), (col("o.modname") == col("l.modname")) & col("o.qualname").isNull(), "left")
    has = [F.when(col(f"has_{r}"), r) for r in ("get", "set", "del")]
    return objects.select(
        "o.modname", "o.qualname", "type_name", "line_start", "line_end", F.array_join(shown, ",").alias("params"),
        F.array_join("bases", ",").alias("bases"), "doc", F.array_join("all_names", ",").alias("names"),
        F.concat_ws(",", *has).alias("accessors"))


CACHES = with_views("scan", "cache1", "cache2")
SAME = "c.mod_id = s.mod_id AND c.version = s.version AND c.path = s.path AND c.mtime = s.mtime AND c.size = s.size"


@query("a10_cache_rows", """SELECT user_id AS mod_id, CAST(CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS generation, CAST(count(*) AS BIGINT) AS n,
CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events WHERE user_id % 5 <> 0 AND (user_id % 3 <> 0 OR event_type = 'click') GROUP BY user_id""")
def cache_rows(t):
    """Entries stored for every module, stored anew for a third of them, some evicted, and read back."""
    spark, folder = t.spark, shared_folder(t.spark, "cache")
    events = t.read("events").select(col("user_id").alias("mod_id"), col("user_id").cast("string").alias("modname"), "event_type")
    entries = events.select("mod_id", "modname", F.to_json(F.struct("event_type")).alias("payload"))
    prints = events.select("mod_id", "modname").distinct().select(
        "mod_id", "modname", F.lit(1).alias("version"), F.concat("modname", F.lit(".py")).alias("path"),
        F.lit(1.0).alias("mtime"), F.lit(1).cast("bigint").alias("size"))
    third = col("mod_id") % 3 == 0
    C.commit(spark, folder, entries, prints, "first")
    C.commit(spark, folder, entries.filter(third & col("payload").contains("click")),
             prints.filter(third).withColumn("size", F.lit(2).cast("bigint")), "second")
    # The scan finds a fifth of the modules changed.
    scan = C.index(spark, folder).withColumn("size", col("size") + F.when(col("modname").cast("bigint") % 5 == 0, 1).otherwise(0))
    before = C.index(spark, folder).select("modname", "generation")
    C.compact(spark, folder, scan)
    return C.load(spark, folder).join(before, "modname").groupBy("modname", "generation").agg(
        F.count("*").alias("n"), F.countDistinct("payload").alias("kinds")
    ).select(col("modname").cast("bigint").alias("mod_id"), "generation", "n", "kinds")


@query("a11_tiered_lookup", CACHES + f""" SELECT s.mod_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM cache1 c WHERE {SAME}) THEN 1
WHEN EXISTS (SELECT 1 FROM cache2 c WHERE {SAME}) THEN 2 ELSE 0 END AS BIGINT) AS tier FROM scan s""")
def tiered_lookup(t):
    return C.tiered_lookup(t.scan(), [t.cache1(), t.cache2()], key="mod_id").select("mod_id", "tier")


@query("a12_stale_entries", CACHES + f""" SELECT c.mod_id, c.size FROM cache1 c WHERE NOT EXISTS (SELECT 1 FROM scan s WHERE {SAME})""")
def stale_entries(t):
    return C.stale(t.cache1(), t.scan(), key="mod_id").select("mod_id", "size")


@query("a13_evict", CACHES + f""" SELECT c.mod_id, CAST(c.version AS BIGINT) AS version, c.size FROM cache2 c WHERE EXISTS (SELECT 1 FROM scan s WHERE {SAME})
OR NOT EXISTS (SELECT 1 FROM scan s WHERE s.mod_id = c.mod_id)""")
def evict(t):
    return C.evict(t.cache2(), t.scan(), key="mod_id").select(
        "mod_id", col("version").cast("bigint").alias("version"), "size")


@query("a14_precompute_list", CACHES + f""" SELECT DISTINCT s.mod_id FROM scan s WHERE NOT EXISTS (SELECT 1 FROM cache1 c WHERE {SAME})""")
def precompute_list(t):
    """Modules named several times, kept once, without those that are fresh."""
    asked = t.scan().union(t.scan()).distinct()
    return C.stale(asked, t.cache1(), key="mod_id").select("mod_id")


@query("a14_refresh", """SELECT 'docs.m' || doc_id AS modname, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS generation,
CAST(CASE WHEN lang = 'de' THEN 0 ELSE 9 END AS BIGINT) AS n FROM documents""")
def refresh_twice(t):
    """Sources extracted into a cache, and again after a third of them was touched."""
    spark, folder = t.spark, shared_folder(t.spark, "cache")
    snapshots = _sources(t).select(
        "*", F.lit(1).alias("version"), F.lit(1.0).alias("mtime"), F.length("source").cast("bigint").alias("size"))
    C.refresh_sources(spark, snapshots, folder, "first")
    third = F.regexp_extract("modname", "([0-9]+)$", 1).cast("bigint") % 3 == 0
    C.refresh_sources(spark, snapshots.withColumn("mtime", F.when(third, 2.0).otherwise(1.0)), folder, "second")
    found = C.load(spark, folder).groupBy("modname").agg(F.count("*").alias("n"))
    return C.index(spark, folder).select("modname", "generation").join(found, "modname", "left").select(
        "modname", "generation", F.coalesce("n", F.lit(0)).alias("n"))


@query("a15_cacheable", """SELECT event_id, path IS NOT NULL AS second_tier, path IS NOT NULL AND NOT (path = '/usr/lib/click' OR starts_with(path, '/usr/lib/click/')) AS first_tier
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN '/usr/lib/' || event_type || '/m' || user_id || '.py' END AS path FROM events)""")
def cacheable(t):
    path = F.when(col("event_type") != "error", F.concat(
        F.lit("/usr/lib/"), "event_type", F.lit("/m"), "user_id", F.lit(".py")))
    prefix = F.lit("/usr/lib/click")
    return t.read("events").select(
        "event_id", C.cacheable(path, prefix, False).alias("second_tier"),
        F.coalesce(C.cacheable(path, prefix, True), F.lit(False)).alias("first_tier"))


@query("a16_bad_sources", "SELECT 'docs.m' || doc_id AS modname, 'docs/m' || doc_id || '.py' AS path FROM documents WHERE lang = 'de'")
def bad_sources(t):
    _, failed = E.split_errors(E.parse_sources(_sources(t)))
    return failed.select("modname", "path")


@query("a17_parameter_rows", with_views("params") + """ SELECT obj, pos, name, kind, CASE WHEN kind = 'KEYWORD_ONLY' THEN '1' END AS default_repr,
CASE WHEN pos = 1 THEN 'int' END AS annotation FROM params""")
def parameter_rows(t):
    """Whole signatures, below three wrappers in a class, as JSON documents and back to parameter rows."""
    kind = col("kind")
    own = F.concat(
        F.lit('{"name": "'), "name", F.lit('", "kind": "'), "kind", F.lit('"'),
        F.when(kind == "KEYWORD_ONLY", F.lit(', "default": {"repr": "1"}')).otherwise(""),
        F.when(col("pos") == 1, F.lit(', "annotation": {"$ref": "#/modules/builtins/dict/int"}')).otherwise(""),
        F.lit("}"))
    # A signature has as many parameters as an order has lines.
    signed = t.params().groupBy("obj").agg(F.array_sort(F.collect_list(F.struct("pos", own.alias("json")))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["json"]), ", ")
    documents = signed.select(F.concat(
        F.lit('{"modules": {"'), "obj", F.lit('": {"dict": {"C": {"dict": {"f": {"func": {"func": {"func": {"signature": {"params": ['),
        text, F.lit("]}}}}}}}}}}}}")).alias("json"))
    return D.params(D.flatten(documents)).filter("role = 'func.func.func' AND qualname = 'C.f'").select(
        col("modname").alias("obj"), "pos", "name", "kind", "default_repr", "annotation")
