"""Queries over names, paths and refs of every object."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.plans.registry import query
from docloom.plans.tables import with_views

col = F.col
SYM = with_views("sym")


@query("b01_path", SYM + """ SELECT modname, q AS qualname FROM
(SELECT modname, CASE WHEN type_qual = 'int' AND starts_with(name, '_') THEN '' ELSE qualname END AS q FROM sym)
WHERE q IS NULL OR q <> ''""")
def path(t):
    blanked = F.when((col("type_qual") == "int") & col("name").startswith("_"), "").otherwise(
        col("qualname"))
    keyed = t.sym().select(N.path(col("modname"), blanked).alias("p"))
    return keyed.filter("p IS NOT NULL").select("p.modname", "p.qualname")


@query("b02_full_name", SYM + """ SELECT CASE WHEN qualname IS NULL THEN modname
ELSE modname || '.' || qualname END AS full_name FROM sym""")
def full_name(t):
    return t.sym().select(N.full_name(col("modname"), col("qualname")).alias("full_name"))


@query("b03_last_name", SYM + """ SELECT modname, qualname, list_last(string_split(qualname, '.')) AS last_name
FROM sym""")
def last_name(t):
    return t.sym().select("modname", "qualname", N.last_part(col("qualname")).alias("last_name"))


@query("b04_child_path", SYM + """ SELECT modname, CASE WHEN qualname IS NULL THEN 'kid'
ELSE qualname || '.kid' END AS child FROM sym""")
def child_path(t):
    return t.sym().select("modname", N.child(col("qualname"), F.lit("kid")).alias("child"))


RAW_PRIVATE = """(SELECT modname, CASE WHEN name LIKE '%\\_\\_s%' ESCAPE '\\' AND name NOT LIKE '%\\_\\_' ESCAPE '\\'
  THEN concat(parent_qual, '.__s', CAST(length(name) AS VARCHAR)) ELSE qualname END AS q FROM sym)"""


def _raw_private(t):
    hidden = col("name").contains("__s") & ~col("name").endswith("__")
    raw = F.concat(col("parent_qual"), F.lit(".__s"), F.length("name").cast("string"))
    return t.sym().select("modname", F.when(hidden, raw).otherwise(col("qualname")).alias("q"))


@query("b05_mangle", SYM + f""" SELECT modname, q, CASE WHEN len(p) >= 2 AND starts_with(p[-1], '__')
THEN array_to_string(p[:-2], '.') || '._' || p[-2] || p[-1] END AS mangled
FROM (SELECT modname, q, string_split(q, '.') AS p FROM {RAW_PRIVATE})""")
def mangle(t):
    return _raw_private(t).select("modname", "q", N.mangle(col("q")).alias("mangled"))


UNMANGLE_SQL = """SELECT name, CASE WHEN m THEN substr(name, 2, strpos(substr(name, 2), '__') - 1) END AS parent,
CASE WHEN m THEN substr(substr(name, 2), strpos(substr(name, 2), '__')) ELSE name END AS plain
FROM (SELECT name, starts_with(name, '_') AND NOT starts_with(name, '__')
  AND strpos(substr(name, 2), '__') > 0 AS m FROM sym)"""


@query("b06_unmangle", SYM + " " + UNMANGLE_SQL)
def unmangle(t):
    u = N.unmangle(col("name"))
    return t.sym().select("name", u["parent"].alias("parent"), u["name"].alias("plain"))


REF_SQL = """'#/modules/' || modname || CASE WHEN qualname IS NULL THEN ''
ELSE '/dict/' || replace(qualname, '.', '/dict/') END"""


@query("b07_make_ref", SYM + f" SELECT modname, qualname, {REF_SQL} AS ref FROM sym")
def make_ref(t):
    return t.sym().select(
        "modname", "qualname", N.make_ref(col("modname"), col("qualname")).alias("ref"))


@query("b08_is_ref", with_views("sym", "imports") + """ SELECT is_ref, CAST(count(*) AS BIGINT) AS n FROM
(SELECT false AS is_ref FROM sym UNION ALL SELECT target_mod IS NOT NULL FROM imports) GROUP BY is_ref""")
def is_ref(t):
    objects = t.sym().select(F.lit(None).cast("string").alias("ref"))
    aliases = t.imports().select(
        N.make_ref(col("target_mod"), col("target_qual")).alias("ref"))
    return objects.union(aliases).groupBy(N.is_ref(col("ref")).alias("is_ref")).agg(
        F.count("*").alias("n"))


@query("b09_parse_ref", SYM + """, bad AS (
  SELECT modname, qualname, CASE WHEN type_qual = 'property' THEN true ELSE false END AS broken FROM sym)
SELECT modname AS in_mod, qualname AS in_qual, CASE WHEN NOT broken THEN modname END AS modname,
  CASE WHEN NOT broken THEN qualname END AS qualname FROM bad""")
def parse_ref(t):
    ref = N.make_ref(col("modname"), col("qualname"))
    broken = F.when(col("type_qual") == "property", F.replace(ref, F.lit("/dict/"), F.lit("/attr/")))
    p = N.parse_ref(F.coalesce(broken, ref))
    return t.sym().select(
        col("modname").alias("in_mod"), col("qualname").alias("in_qual"),
        p["modname"].alias("modname"), p["qualname"].alias("qualname"))


@query("b10_own_path", with_views("sym", "imports") + """
SELECT name, modname AS own_mod, qualname AS own_qual FROM sym WHERE type_qual <> 'int'
UNION ALL SELECT name, NULL, NULL FROM sym WHERE type_qual = 'int'
UNION ALL SELECT member_name, target_mod, target_qual FROM imports""")
def own_path(t):
    none = F.lit(None).cast("string")
    objects = t.sym().select(
        none.alias("ref"), col("type_qual").alias("type_name"), "name",
        # Plain values do not know where they live.
        F.when(col("type_qual") != "int", N.make_ref(col("modname"), none)).alias("module_ref"),
        "qualname")
    aliases = t.imports().select(
        N.make_ref(col("target_mod"), col("target_qual")).alias("ref"), none.alias("type_name"),
        col("member_name").alias("name"), none.alias("module_ref"), none.alias("qualname"))
    p = N.own_path(col("ref"), col("type_name"), col("name"), col("module_ref"), col("qualname"))
    return objects.unionByName(aliases).select("name", p.alias("p")).select(
        "name", col("p.modname").alias("own_mod"), col("p.qualname").alias("own_qual"))


@query("b11_dotname", SYM + """ SELECT modname, name, joined, from_parts FROM (SELECT modname, name,
  CASE WHEN list_contains(string_split(j, '.'), '') THEN NULL ELSE j END AS joined,
  CASE WHEN strpos(coalesce(qualname, 'x.y'), '.') = 0 THEN modname_last || '.' || qualname END AS from_parts
FROM (SELECT *, modname || '.' || coalesce(parent_qual, '') || '.' || name AS j,
  list_last(string_split(modname, '.')) AS modname_last FROM sym))""")
def dotname(t):
    # Objects without a parent give an empty part, which is refused.
    joined = N.join_name(col("modname"), F.coalesce(col("parent_qual"), F.lit("")), col("name"))
    pieces = F.array(N.last_part(col("modname")), F.coalesce(col("qualname"), F.lit("x.y")))
    return t.sym().select(
        "modname", "name", joined.alias("joined"), N.join_parts(pieces).alias("from_parts"))


@query("b12_parts", SYM + """ SELECT full_name, p[-1] AS last_part, CAST(len(p) AS BIGINT) AS n_parts,
array_to_string(p, '|') AS parts FROM (SELECT concat_ws('.', modname, qualname) AS full_name,
  string_split(concat_ws('.', modname, qualname), '.') AS p FROM sym)""")
def name_parts(t):
    full = t.sym().select(N.full_name(col("modname"), col("qualname")).alias("full_name"))
    return full.select(
        "full_name", N.last_part(col("full_name")).alias("last_part"),
        N.n_parts(col("full_name")).alias("n_parts"),
        F.array_join(N.parts(col("full_name")), "|").alias("parts"))


@query("b13_ancestors", SYM + """ SELECT full_name, CAST(len(p) - 1 - i AS BIGINT) AS distance,
array_to_string(p[:i], '.') AS ancestor FROM (
  SELECT full_name, p, unnest(range(1, len(p))) AS i FROM (
    SELECT concat_ws('.', modname, qualname) AS full_name,
      string_split(concat_ws('.', modname, qualname), '.') AS p FROM sym))""")
def ancestors(t):
    full = t.sym().select(N.full_name(col("modname"), col("qualname")).alias("full_name"))
    return full.select(
        "full_name", F.posexplode(N.ancestor_names(col("full_name"))).alias("distance", "ancestor")
    ).select("full_name", col("distance").cast("bigint").alias("distance"), "ancestor")


@query("b14_with_name", SYM + """ SELECT q AS qualname, q || '.leaf' AS joined,
CASE WHEN strpos(q, '.') > 0 THEN array_to_string(string_split(q, '.')[:-2], '.') || '.new.leaf' END AS renamed
FROM (SELECT qualname AS q FROM sym WHERE qualname IS NOT NULL)""")
def with_name(t):
    return t.sym().filter("qualname IS NOT NULL").select(
        "qualname", N.join_name(col("qualname"), F.lit("leaf")).alias("joined"),
        N.with_last(col("qualname"), F.lit("new.leaf")).alias("renamed"))


@query("b15_name_order", SYM + """ SELECT modname, min(f) AS first_name, max(f) AS last_name,
CAST(count_if(f < 'pkg.b') AS BIGINT) AS n_before
FROM (SELECT modname, concat_ws('.', modname, qualname) AS f FROM sym) GROUP BY modname""")
def name_order(t):
    f = N.full_name(col("modname"), col("qualname"))
    return t.sym().select("modname", f.alias("f")).groupBy("modname").agg(
        F.min("f").alias("first_name"), F.max("f").alias("last_name"),
        F.count_if(col("f") < "pkg.b").alias("n_before"))


@query("b16_valid_qualname", SYM + """, named AS (SELECT qualname AS q FROM sym WHERE qualname IS NOT NULL
  UNION ALL SELECT p_type FROM part UNION ALL SELECT replace(p_name, ' ', '.') FROM part)
SELECT q, regexp_full_match(q, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*') AS valid FROM named""")
def valid_qualname(t):
    part = t.read("part")
    named = (
        t.sym().filter("qualname IS NOT NULL").select(col("qualname").alias("q"))
        .union(part.select("p_type"))
        .union(part.select(F.replace("p_name", F.lit(" "), F.lit("."))))
    )
    return named.select("q", N.is_qualname(col("q")).alias("valid"))


@query("b17_subpath", """ SELECT page_id, p = '/' || host || '/en' OR starts_with(p, '/' || host || '/en/') AS inside
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages)""")
def subpath(t):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    file_path = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1))
    root = F.concat(F.lit("/"), host, F.lit("/en"))
    return t.read("pages").select("page_id", N.is_subpath(file_path, root).alias("inside"))


@query("b18_context_name", SYM + """ SELECT modname, qualname, type_qual,
CASE WHEN qualname IS NOT NULL AND m IN ('builtins', 'pkg.asia') THEN qualname
  ELSE concat_ws('.', m, qualname) END AS shown
FROM (SELECT *, CASE WHEN type_qual = 'int' THEN 'builtins' ELSE modname END AS m FROM sym)""")
def context_name(t):
    shown_mod = F.when(col("type_qual") == "int", "builtins").otherwise(col("modname"))
    return t.sym().select(
        "modname", "qualname", "type_qual",
        N.context_name(shown_mod, col("qualname"), F.lit("pkg.asia")).alias("shown"))


@query("b19_relative_name", SYM + """ SELECT modname, qualname,
CASE WHEN qualname IS NULL THEN modname ELSE qualname END AS from_module,
CASE WHEN qualname IS NULL THEN modname
  WHEN modname = 'pkg.asia' AND starts_with(qualname, 'N8.') THEN substr(qualname, 4)
  ELSE modname || '.' || qualname END AS from_class,
CASE WHEN parent_qual IS NOT NULL THEN modname || '.' || parent_qual || '.alt' ELSE modname || '.alt' END AS renamed
FROM sym""")
def relative_name(t):
    none = F.lit(None).cast("string")
    m, q = col("modname"), col("qualname")
    return t.sym().select(
        "modname", "qualname",
        N.relative_name(m, q, m, none).alias("from_module"),
        N.relative_name(m, q, F.lit("pkg.asia"), F.lit("N8")).alias("from_class"),
        N.relative_name(m, q, none, none, name=F.lit("alt")).alias("renamed"))


@query("b20_page_link", with_views("sym", "imports") + """
SELECT modname || ':' || coalesce(qualname, '') AS page, '/' || modname || '/' || coalesce(qualname, '') AS link FROM sym
UNION ALL SELECT modname || ':' || member_name, '/' || target_mod || '/' || target_qual FROM imports""")
def page_link(t):
    objects = t.sym().select(
        F.concat(col("modname"), F.lit(":"), F.coalesce(col("qualname"), F.lit(""))).alias("page"),
        N.page_link(col("modname"), col("qualname")).alias("link"))
    # The page of a ref leads to its target.
    target = N.parse_ref(N.make_ref(col("target_mod"), col("target_qual")))
    aliases = t.imports().select(
        F.concat_ws(":", "modname", "member_name").alias("page"),
        N.page_link(target["modname"], target["qualname"]).alias("link"))
    return objects.unionByName(aliases)


@query("b21_tree_label", SYM + """ SELECT f, CASE WHEN len(p) = 1 THEN f
ELSE repeat(' ', CAST(2 * (len(p) - 1) AS INTEGER)) || '.' || p[-1] END AS label
FROM (SELECT concat_ws('.', modname, parent_qual) AS f, string_split(concat_ws('.', modname, parent_qual), '.') AS p
  FROM sym) UNION ALL SELECT p_brand, p_brand FROM part WHERE strpos(p_brand, '.') = 0""")
def tree_label(t):
    packages = t.sym().select(N.full_name(col("modname"), col("parent_qual")).alias("f"))
    top = t.read("part").filter(~col("p_brand").contains(".")).select(col("p_brand").alias("f"))
    return packages.union(top).select("f", N.tree_label(col("f")).alias("label"))


@query("b22_if_null", SYM + " SELECT modname, name, coalesce(parent_qual, modname) AS owner FROM sym")
def if_null(t):
    return t.sym().select(
        "modname", "name", N.if_null(col("parent_qual"), col("modname")).alias("owner"))


@query("b23_claimed_path", SYM + """ SELECT name, type_qual,
CASE WHEN type_qual = 'module' THEN name WHEN type_qual <> 'int' THEN modname END AS claimed_mod,
CASE WHEN type_qual NOT IN ('module', 'int') THEN qualname END AS claimed_qual FROM sym""")
def claimed_path(t):
    module = F.when(col("type_qual") != "int", col("modname"))
    p = N.claimed_path(col("type_qual") == "module", col("name"), module, col("qualname"))
    return t.sym().select(
        "name", "type_qual", p["modname"].alias("claimed_mod"), p["qualname"].alias("claimed_qual"))


@query("b24_typed_ref", SYM + f""" SELECT {REF_SQL} AS ref,
'#/modules/builtins/dict/' || type_qual AS type_ref FROM sym""")
def typed_ref(t):
    r = N.typed_ref(col("modname"), col("qualname"), F.lit("builtins"), col("type_qual"))
    return t.sym().select(r["ref"].alias("ref"), r["type_ref"].alias("type_ref"))
