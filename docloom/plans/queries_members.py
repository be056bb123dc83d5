"""Queries over members: visibility, labels, categories, grouping and set work."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import arrays as A
from docloom.functions import names as N
from docloom.functions import objects as O
from docloom.operators import members as M
from docloom.operators.sequence import subset_rows
from docloom.plans.registry import query
from docloom.plans.tables import with_views

col = F.col
SYM = with_views("sym")
MEMBERS = with_views("members")
OBJECTS = with_views("objects")

# Module `__all__`: africa has no such key, america has null, the others list every second class.
LISTED_SQL = "list_contains(list_transform(range(0, 25, 2), lambda i: concat('N', i)), member_name)"
EXPORTED_SQL = f"""CASE WHEN parent_qual IS NULL AND parent_mod NOT IN ('pkg.africa', 'pkg.america')
  THEN {LISTED_SQL} END"""


def _all_names(modname):
    listed = F.transform(F.sequence(F.lit(0), F.lit(24), F.lit(2)), lambda i: F.concat(F.lit("N"), i))
    return F.when(~modname.isin("pkg.africa", "pkg.america"), listed)


def _parents(t):
    return t.sym().filter(col("type_qual").isin("module", "type")).select(
        "modname", "qualname", col("type_qual").alias("type_name"),
        (col("modname") != "pkg.africa").alias("has_all_names"),
        F.when(col("qualname").isNull(), _all_names(col("modname"))).alias("all_names"))


def _exported():
    return O.is_exported(
        col("member_name"), F.when(col("parent_qual").isNull(), _all_names(col("parent_mod"))))


@query("c01_visible_members", MEMBERS + f""" SELECT parent_mod, parent_qual, member_name, is_ref FROM members
WHERE CASE WHEN parent_qual IS NULL THEN CASE WHEN parent_mod = 'pkg.africa' THEN NOT starts_with(member_name, '_')
    WHEN parent_mod = 'pkg.america' THEN true ELSE {LISTED_SQL} END
  ELSE NOT starts_with(member_name, '_') OR (starts_with(member_name, '__') AND ends_with(member_name, '__')) END""")
def visible_members(t):
    return M.visible(t.members(), _parents(t)).select(
        "parent_mod", "parent_qual", "member_name", "is_ref")


@query("c02_own_members", MEMBERS + """ SELECT parent_mod, parent_qual, member_name FROM members WHERE NOT is_ref""")
def own_members(t):
    return M.visible(t.members(), _parents(t), private=True, imports=False).select(
        "parent_mod", "parent_qual", "member_name")


@query("c03_member_marks", MEMBERS + f""" SELECT parent_mod, member_name,
is_ref AND NOT coalesce(e, false) AS imported_name,
starts_with(member_name, '_') AND NOT coalesce(e, false) AS private_name
FROM (SELECT *, {EXPORTED_SQL} AS e FROM members)""")
def member_marks(t):
    marks = O.member_marks(col("is_ref"), col("member_name"), _exported())
    return t.members().select("parent_mod", "member_name", marks.alias("m")).select(
        "parent_mod", "member_name", "m.*")


@query("c04_exported", MEMBERS + f" SELECT parent_mod, parent_qual, member_name, {EXPORTED_SQL} AS exported FROM members")
def exported(t):
    return t.members().select(
        "parent_mod", "parent_qual", "member_name", _exported().alias("exported"))


ENTRY_NAMES = [*O.INTERNAL_NAMES, "__init__", "run", "_x"]
ENTRY_SQL = "[" + ", ".join(f"'{n}'" for n in ENTRY_NAMES) + "]"


@query("c05_drop_internal", f""" SELECT o_orderkey, name FROM (SELECT o_orderkey,
  {ENTRY_SQL}[CAST(o_custkey % 16 AS INTEGER) + 1] AS name FROM orders) WHERE name IN ('__init__', 'run', '_x')""")
def drop_internal(t):
    names = F.array(*[F.lit(n) for n in ENTRY_NAMES])
    entries = t.read("orders").select(
        "o_orderkey", F.get(names, (col("o_custkey") % 16).cast("int")).alias("name"))
    return entries.filter(~O.is_internal(col("name")))


@query("c06_callable", OBJECTS + """ SELECT o.modname, o.qualname, o.callable OR coalesce(f.callable, false) AS callable
FROM objects o LEFT JOIN objects f ON f.role = 'func' AND f.modname = o.modname AND f.qualname = o.qualname
WHERE o.role = 'self'""")
def callable_objects(t):
    return M.attach_func(t.objects(), ["callable"]).select(
        "modname", "qualname", O.is_callable(col("callable"), col("func_callable")).alias("callable"))


@query("c07_function_like", OBJECTS + """ SELECT o.modname, o.qualname, CASE WHEN f.role IS NOT NULL
  THEN f.callable AND f.type_name <> 'type' ELSE o.callable AND o.type_name <> 'type' END AS function_like
FROM objects o LEFT JOIN objects f ON f.role = 'func' AND f.modname = o.modname AND f.qualname = o.qualname
WHERE o.role = 'self'""")
def function_like(t):
    joined = M.attach_innermost(t.objects(), ["callable", "type_name"])
    return joined.select("modname", "qualname", O.is_function_like(
        col("wraps"), col("callable"), col("type_name"), col("inner_callable"),
        col("inner_type_name")).alias("function_like"))


DOC_SQL = """CASE WHEN num % 3 = 0 THEN NULL WHEN num % 3 = 1 THEN concat('about ', type_name)
  ELSE concat('about ', name) END"""


@query("c08_own_doc", OBJECTS + f""", types AS (SELECT DISTINCT type_name, concat('about ', type_name) AS type_doc FROM objects)
SELECT modname, qualname, doc FROM (SELECT o.*, {DOC_SQL.replace('type_name', 'o.type_name')} AS doc, type_doc
  FROM objects o JOIN types t ON t.type_name = o.type_name WHERE role = 'self')
WHERE doc IS NOT NULL AND (type_name = 'type' OR doc <> type_doc)""")
def own_doc(t):
    kind, num = col("type_name"), col("num")
    about = F.lit("about ")
    objects = t.objects().filter("role = 'self'").withColumn(
        "doc", F.when(num % 3 == 0, F.lit(None)).when(num % 3 == 1, F.concat(about, kind))
        .otherwise(F.concat(about, "name"))
    ).withColumn("type_mod", F.lit("builtins")).withColumn("type_qual", kind)
    types = t.objects().select(
        F.lit("builtins").alias("modname"), kind.alias("qualname"),
        F.concat(about, kind).alias("doc")).distinct()
    joined = M.attach_types(objects, types, ["doc"])
    return joined.filter(
        O.owns_doc(col("doc"), kind == "type", col("type_row_doc"))
    ).select("modname", "qualname", "doc")


@query("c09_stored_repr", """ SELECT doc_id, CASE WHEN lang <> 'de' THEN CAST(length(left(r, 65536)) AS BIGINT) END AS n,
CASE WHEN lang <> 'de' THEN md5(left(r, 65536)) END AS digest FROM (SELECT doc_id, lang, repeat(text, 3) AS r FROM documents)""")
def stored_repr(t):
    kept = O.stored_repr(F.repeat(col("text"), F.lit(3)), col("lang") == "de")
    return t.read("documents").select("doc_id", kept.alias("r")).select(
        "doc_id", F.length("r").cast("bigint").alias("n"), F.md5("r").alias("digest"))


@query("c10_show_repr", SYM + """ SELECT modname, qualname, type_qual NOT IN ('classmethod', 'function', 'module', 'property', 'staticmethod', 'type') AS on_page,
type_qual NOT IN ('module', 'property', 'type', 'function') AS on_terminal_row,
type_qual NOT IN ('module', 'property', 'type', 'function', 'getset_descriptor') AS on_web_row FROM sym""")
def show_repr(t):
    shown, kind = F.concat(F.lit("<"), "name", F.lit(">")), col("type_qual")
    signed = kind == "function"
    return t.sym().select(
        "modname", "qualname",
        O.shows_page_repr(shown, F.lit("builtins"), kind).alias("on_page"),
        O.shows_member_repr(shown, signed, kind).alias("on_terminal_row"),
        O.shows_member_repr(shown, signed, kind, web=True).alias("on_web_row"))


@query("c11_is_package", SYM + """ SELECT name, name = CASE WHEN type_qual = 'module' THEN modname ELSE parent_qual END
AND type_qual = 'module' AS is_package FROM sym""")
def is_package(t):
    package = F.when(col("type_qual") == "module", col("modname")).otherwise(col("parent_qual"))
    return t.sym().select(
        "name", O.is_package(col("name"), package).alias("is_package"))


@query("c12_split_by", """ SELECT is_error, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM
(SELECT event_type = 'error' AS is_error, event_id FROM events) GROUP BY is_error""")
def split_by(t):
    no, yes = M.split_by(t.read("events").select("event_id", "event_type"), col("event_type") == "error")
    tally = [F.count("*").alias("n"), F.sum("event_id").alias("ids")]
    return no.agg(*tally).withColumn("is_error", F.lit(False)).unionByName(
        yes.agg(*tally).withColumn("is_error", F.lit(True)))


@query("c13_display_name", SYM + """ SELECT m, q, CASE WHEN k = 4 THEN '' WHEN k = 5 OR q IS NULL THEN ''
  WHEN ends_with(q, '.' || name) THEN left(q, length(q) - length(name)) ELSE '' END AS lead,
CASE WHEN k = 4 THEN '(unnamed object)' WHEN q IS NULL THEN name WHEN ends_with(q, '.' || name) THEN name ELSE q END AS last
FROM (SELECT CASE WHEN type_qual = 'int' THEN modname ELSE 'self' END AS m, length(name) % 5 AS k,
  CASE WHEN length(name) % 5 = 4 THEN NULL ELSE qualname END AS q, name FROM sym)""")
def display_name(t):
    nameless = F.length("name") % 5 == 4
    q = F.when(~nameless, col("qualname"))
    shown = O.display_name(q, F.lit(None).cast("string"), F.when(~nameless, col("name")))
    module = O.display_module(F.when(col("type_qual") != "int", F.lit("self")), col("modname"))
    return t.sym().select(module.alias("m"), q.alias("q"), shown.alias("s")).select(
        "m", "q", "s.lead", "s.last")


@query("c14_source_location", """ SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_shipmode_f ELSE file END AS where_found,
CAST(l_linenumber AS BIGINT) AS first_line, CAST(l_linenumber + l_quantity AS BIGINT) - 1 AS last_line,
concat('lines ', l_linenumber, '-', CAST(l_linenumber + l_quantity AS BIGINT)) AS shown
FROM (SELECT *, concat('s', l_suppkey, '.py') AS l_shipmode_f, concat('p', l_partkey, '.so') AS file FROM lineitem)""")
def source_location(t):
    source_file = F.when(
        col("l_linestatus") == "O", F.concat(F.lit("s"), "l_suppkey", F.lit(".py"))).otherwise("")
    start = (col("l_linenumber") - 1).cast("bigint")
    end = (col("l_linenumber") + col("l_quantity")).cast("bigint") - 1
    loc = O.source_location(source_file, F.concat(F.lit("p"), "l_partkey", F.lit(".so")), start, end)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", loc.alias("s")).select(
        "l_orderkey", "l_linenumber", col("s.file").alias("where_found"),
        "s.first_line", "s.last_line", "s.shown")


@query("c15_type_label", OBJECTS + """, acc AS (SELECT modname, qualname, bool_or(role = 'get') AS g, bool_or(role = 'set') AS s,
  bool_or(role = 'del') AS d, max(num) AS num FROM objects GROUP BY modname, qualname),
lab AS (SELECT o.modname, o.qualname, o.type_name, o.num, CASE o.type_name
  WHEN 'property' THEN concat_ws('/', CASE WHEN g THEN 'get' END, CASE WHEN s THEN 'set' END, CASE WHEN d THEN 'del' END) || ' property'
  WHEN 'function' THEN CASE WHEN o.num % 4 = 0 THEN 'lambda function' ELSE 'function' END
  WHEN 'classmethod' THEN 'class method' WHEN 'staticmethod' THEN 'static method'
  WHEN 'getset_descriptor' THEN 'extension property' END AS label
FROM objects o JOIN acc a ON a.modname = o.modname AND a.qualname IS NOT DISTINCT FROM o.qualname WHERE o.role = 'self')
SELECT modname, qualname, label, CASE WHEN type_name = 'int' THEN 'instance of int' ELSE coalesce(label, type_name) END AS on_page FROM lab""")
def type_label(t):
    roles = M.accessors(t.objects()).groupBy("modname", "qualname").agg(*[
        F.bool_or((col("accessor") == w) & col("present")).alias(f"has_{w}")
        for w in ("get", "set", "del")])
    own = t.objects().filter("role = 'self'").join(roles, ["modname", "qualname"], "left")
    name = F.when(
        (col("type_name") == "function") & (col("num") % 4 == 0), "<lambda>").otherwise(col("name"))
    label = O.type_label(
        F.lit("builtins"), col("type_name"), name, col("has_get"), col("has_set"), col("has_del"))
    type_mod = F.when(col("type_name") == "int", "numbers").otherwise("builtins")
    return own.withColumn("label", label).select(
        "modname", "qualname", "label",
        O.page_type_label(col("label"), col("type_name"), type_mod).alias("on_page"))


@query("e01_categories", SYM + """ SELECT parent, category, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_ref FROM (
SELECT concat_ws('.', modname, parent_qual) AS parent, CASE type_qual WHEN 'module' THEN 'modules' WHEN 'type' THEN 'types' WHEN 'property' THEN 'properties'
  WHEN 'function' THEN 'functions' WHEN 'staticmethod' THEN 'functions' WHEN 'classmethod' THEN 'functions' ELSE 'attributes' END AS category
FROM sym) GROUP BY parent, category""")
def categories(t):
    marked = t.sym().select(
        N.full_name(col("modname"), col("parent_qual")).alias("parent"),
        O.category(F.lit("builtins"), col("type_qual")).alias("category"),
        F.lit(False).alias("is_ref"))
    return M.by_category(marked, "parent")


@query("e02_count_true", """ SELECT user_id, CAST(count_if(value > 10) AS BIGINT) AS n FROM events GROUP BY user_id""")
def count_true(t):
    return t.read("events").groupBy("user_id").agg(F.count_if(col("value") > 10).alias("n"))


@query("e03_dot_product", """ SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CAST(embedding[len(embedding) + 1 - i] AS DOUBLE))), 6) AS dot FROM embeddings""")
def dot_product(t):
    v = col("embedding")
    return t.read("embeddings").select("vec_id", F.round(A.dot(v, F.reverse(v)), 6).alias("dot"))


@query("e04_distinct_modules", with_views("sym", "imports") + """ SELECT DISTINCT modname FROM
(SELECT modname FROM sym UNION ALL SELECT target_mod FROM imports)""")
def distinct_modules(t):
    every = t.sym().select("modname").union(t.imports().select("target_mod"))
    return every.distinct().orderBy("modname")


@query("e05_member_listing", MEMBERS + """ SELECT parent_mod, parent_qual, member_name FROM members
WHERE NOT is_ref ORDER BY parent_mod, parent_qual, member_name""")
def member_listing(t):
    return M.listing(t.members(), imports=False).select("parent_mod", "parent_qual", "member_name")


@query("e06_changed_entries", """ SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN o_custkey % 3 = 0 THEN 'cust' END, CASE WHEN o_orderstatus = 'F' THEN 'status' END,
  CASE WHEN o_orderpriority IS NULL OR o_orderpriority <> '1-URGENT' THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS changed FROM orders""")
def changed_entries(t):
    cust, status, prio = col("o_custkey"), col("o_orderstatus"), col("o_orderpriority")
    old = F.create_map(
        F.lit("cust"), cust.cast("string"), F.lit("status"), status, F.lit("priority"), F.lit("1-URGENT"))
    new = F.create_map(
        F.lit("cust"), F.when(cust % 3 == 0, cust + 1).otherwise(cust).cast("string"),
        F.lit("status"), F.when(status == "F", "X").otherwise(status), F.lit("priority"), prio)
    return t.read("orders").select(
        "o_orderkey", F.array_join(F.map_keys(A.changed_entries(old, new)), ",").alias("changed"))


@query("e07_flatten", """ SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words FROM (SELECT doc_id, unnest(flatten(
  list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')))) AS w FROM documents) GROUP BY doc_id""")
def flatten(t):
    words = F.transform(F.split("text", "\n"), lambda l: F.split(l, " "))
    return t.docs().select("doc_id", F.size(A.flatten_once(words)).cast("bigint").alias("n_words"))


@query("e08_repeat", """ SELECT c_mktsegment, CAST(k AS BIGINT) AS cycle, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(c)) AS BIGINT) AS copies
FROM (SELECT c_mktsegment, k, list_transform(range(3), lambda i: c_name) AS c FROM customer, range(4) r(k)) GROUP BY 1, 2""")
def repeat(t):
    from docloom.operators.sequence import cycles

    copies = A.repeat_value(col("c_name"), 3)
    return cycles(t.read("customer").select("c_mktsegment", copies.alias("c")), 4).groupBy(
        "c_mktsegment", "cycle"
    ).agg(F.count("*").alias("n"), F.sum(F.size("c")).alias("copies"))


@query("e09_subsets", """ SELECT p_partkey, s FROM (SELECT p_partkey, unnest(['',
  a, b, c, a || ',' || b, a || ',' || c, b || ',' || c, a || ',' || b || ',' || c]) AS s FROM (
  SELECT p_partkey, p_brand AS a, p_type AS b, CAST(p_size AS VARCHAR) AS c FROM part))""")
def subsets(t):
    items = F.array("p_brand", "p_type", col("p_size").cast("string"))
    rows = subset_rows(t.read("part").select("p_partkey", items.alias("items")), "items")
    return rows.select("p_partkey", F.array_join("subset", ",").alias("s"))


@query("e10_span", """ SELECT p_partkey, array_to_string(range(p_size, p_size + 9, 3), ',') AS half_open,
array_to_string(range(p_size, p_size + 10, 3), ',') AS closed, array_to_string(range(p_size + 3, p_size + 9, 3), ',') AS open,
CASE WHEN p_size > 25 THEN '' ELSE array_to_string(range(p_size, 26), ',') END AS maybe_empty FROM part""")
def span(t):
    low = col("p_size").cast("bigint")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return t.read("part").select(
        "p_partkey",
        text(A.span(low, low + 9, 3)).alias("half_open"),
        text(A.span(low, low + 9, 3, inclusive=True)).alias("closed"),
        text(A.span(low, low + 9, 3, inclusive=False)).alias("open"),
        text(A.span(low, F.lit(26).cast("bigint"))).alias("maybe_empty"))
