"""Queries that resolve refs, aliases, names, inheritance, tags and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.functions import objects as O
from docloom.operators import members as M
from docloom.operators import refs as R
from docloom.operators import signatures as S
from docloom.plans.registry import query
from docloom.plans.tables import with_views

col = F.col

# Follows every alias to its end; used by several checks.
FOLLOW = """, r(modname, member_name, target_mod, target_qual, hops, path) AS (
  SELECT modname, member_name, target_mod, target_qual, 1, concat_ws('.', target_mod, target_qual) FROM imports
  UNION ALL
  SELECT r.modname, r.member_name, i.target_mod, i.target_qual, r.hops + 1,
    r.path || ' > ' || concat_ws('.', i.target_mod, i.target_qual) FROM r
  JOIN imports i ON i.modname = r.target_mod AND i.member_name = r.target_qual),
fin AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM imports i
  WHERE i.modname = r.target_mod AND i.member_name = r.target_qual))
"""
ALIASES = with_views("sym", "imports", recursive=True) + FOLLOW


@query("flagship_members_by_kind", ALIASES + """, typed AS (
  SELECT fin.modname, fin.member_name, s.type_qual, fin.hops FROM fin
  LEFT JOIN sym s ON s.modname = fin.target_mod AND s.qualname = fin.target_qual),
mem AS (SELECT modname, type_qual, false AS is_ref, 0 AS hops FROM sym
    WHERE parent_qual IS NULL AND qualname IS NOT NULL
  UNION ALL SELECT modname, type_qual, true, hops FROM typed)
SELECT modname, CASE WHEN type_qual IS NULL THEN 'unresolved' WHEN type_qual = 'type' THEN 'types'
    ELSE 'attributes' END AS category,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
  CAST(max(hops) AS BIGINT) AS max_hops FROM mem GROUP BY 1, 2""")
def members_by_kind(t):
    """Members of every module with imports resolved, grouped by kind."""
    sym = t.sym()
    ends = R.resolve_aliases(t.imports()).select(
        "modname", "member_name", col("final_mod").alias("target_mod"),
        col("final_qual").alias("target_qual"), "hops")
    typed = R.resolve_once(ends, sym, ["type_qual"]).select(
        "modname", "type_qual", F.lit(True).alias("is_ref"), "hops")
    own = sym.filter("parent_qual IS NULL AND qualname IS NOT NULL").select(
        "modname", "type_qual", F.lit(False).alias("is_ref"), F.lit(0).cast("bigint").alias("hops"))
    category = F.when(col("type_qual").isNull(), "unresolved").otherwise(
        O.category(F.lit("builtins"), col("type_qual")))
    return own.unionByName(typed).groupBy("modname", category.alias("category")).agg(
        F.count("*").alias("n"), F.count_if("is_ref").alias("n_ref"), F.max("hops").alias("max_hops"))


@query("d01_resolve_once", with_views("sym", "imports") + """ SELECT i.modname, i.member_name, s.modname IS NOT NULL AS found, s.type_qual
FROM imports i LEFT JOIN sym s ON s.modname = i.target_mod AND s.qualname = i.target_qual""")
def resolve_once(t):
    return R.resolve_once(t.imports(), t.sym(), ["type_qual"]).select(
        "modname", "member_name", "found", "type_qual")


@query("d02_resolve_aliases", ALIASES + """ SELECT modname, member_name, target_mod AS final_mod, target_qual AS final_qual,
CAST(hops AS BIGINT) AS hops, path, false AS is_cycle FROM fin""")
def resolve_aliases(t):
    return R.resolve_aliases(t.imports(), with_path=True).withColumn(
        "path", F.array_join("path", " > "))


# Aliases as before, except that those of every eighth part lead back to themselves.
LOOPED = with_views("imports", recursive=True) + """, looped AS (SELECT i.modname, i.member_name,
    CASE WHEN loops THEN m.modname ELSE target_mod END AS target_mod,
    CASE WHEN loops THEN concat('imp', p * 4 + 1) ELSE target_qual END AS target_qual FROM (
  SELECT *, CAST(substr(member_name, 4) AS BIGINT) AS p, CAST(substr(member_name, 4) AS BIGINT) % 8 = 0 AS loops FROM imports) i
  JOIN mods m ON m.mod_id = (p * 4 + 1) % 5),
r(modname, member_name, target_mod, target_qual, path) AS (
  SELECT modname, member_name, target_mod, target_qual, [member_name] FROM looped
  UNION ALL SELECT r.modname, r.member_name, i.target_mod, i.target_qual, list_append(r.path, i.member_name) FROM r
  JOIN looped i ON i.modname = r.target_mod AND i.member_name = r.target_qual WHERE NOT list_contains(r.path, i.member_name)),
fin AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM looped i
  WHERE i.modname = r.target_mod AND i.member_name = r.target_qual))"""


@query("d11_alias_cycles", LOOPED + """ SELECT l.modname, l.member_name, fin.target_qual AS final_qual,
CAST(len(fin.path) AS BIGINT) AS hops, fin.modname IS NULL AS is_cycle
FROM looped l LEFT JOIN fin ON fin.modname = l.modname AND fin.member_name = l.member_name""")
def alias_cycles(t):
    p = F.substr("member_name", F.lit(4)).cast("bigint")
    loops = p % 8 == 0
    back = t.mods().select("mod_id", col("modname").alias("back_mod"))
    looped = t.imports().join(back, col("mod_id") == (p * 4 + 1) % 5).select(
        "modname", "member_name",
        F.when(loops, col("back_mod")).otherwise(col("target_mod")).alias("target_mod"),
        F.when(loops, F.concat(F.lit("imp"), p * 4 + 1)).otherwise(col("target_qual"))
        .alias("target_qual"))
    return R.resolve_aliases(looped).select(
        "modname", "member_name", "final_qual", "hops", "is_cycle")


REQUESTS = """, req AS (SELECT modname, CASE type_qual WHEN 'property' THEN qualname || '.x.y'
  WHEN 'classmethod' THEN 'no' || qualname WHEN 'function' THEN parent_qual || '.gone' ELSE qualname END AS q
FROM sym WHERE qualname IS NOT NULL)"""


@query("d03_look_up", with_views("sym") + REQUESTS + """, pre AS (SELECT modname, q, array_to_string(p[:i], '.') AS prefix, i FROM (
  SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT modname, q, string_split(q, '.') AS p FROM req))),
miss AS (SELECT modname, q, min_by(prefix, i) AS missing_name FROM pre WHERE NOT EXISTS (
  SELECT 1 FROM sym s WHERE s.modname = pre.modname AND s.qualname = prefix) GROUP BY modname, q)
SELECT req.modname, req.q AS qualname, missing_name FROM req LEFT JOIN miss USING (modname, q)""")
def look_up(t):
    kind, q = col("type_qual"), col("qualname")
    asked = t.sym().filter("qualname IS NOT NULL").select(
        "modname",
        F.when(kind == "property", F.concat(q, F.lit(".x.y")))
        .when(kind == "classmethod", F.concat(F.lit("no"), q))
        .when(kind == "function", F.concat("parent_qual", F.lit(".gone"))).otherwise(q)
        .alias("qualname"))
    return R.look_up(asked, t.sym())


# Members asked for through an alias of an alias of their class.
THROUGH = """, req AS (SELECT m.modname, concat('imp', p, '.', s.name) AS q, p FROM (
  SELECT s.*, 4 * CASE WHEN c.cls_id = 0 THEN 100 ELSE (76 * c.cls_id) % 100 END + 1 AS p
  FROM sym s JOIN classes c ON c.modname = s.modname AND c.qualname = s.parent_qual) s
JOIN mods m ON m.mod_id = s.p % 5
UNION ALL SELECT concat('no', modname), qualname, NULL FROM sym WHERE type_qual = 'type'
UNION ALL SELECT modname, qualname, NULL FROM sym)"""


def _through(t):
    sym, classes = t.sym(), t.classes()
    k = col("cls_id")
    owned = sym.join(
        classes.select("modname", col("qualname").alias("parent_qual"), "cls_id"),
        ["modname", "parent_qual"])
    p = F.when(k == 0, 100).otherwise((k * 76) % 100) * 4 + 1
    aliased = owned.select(p.alias("p"), "name").join(
        t.mods(), col("mod_id") == col("p") % 5).select(
        "modname", F.concat(F.lit("imp"), "p", F.lit("."), "name").alias("qualname"))
    no_module = sym.filter("type_qual = 'type'").select(
        F.concat(F.lit("no"), "modname").alias("modname"), "qualname")
    plain = sym.select("modname", "qualname")
    return aliased.union(no_module).union(plain)


THROUGH_SQL = with_views("sym", "imports", recursive=True) + FOLLOW + THROUGH + """,
step AS (SELECT req.*, string_split(q, '.')[1] AS head, string_split(q, '.')[2] AS tail FROM req),
hop AS (SELECT step.*, coalesce(fs.modname, CASE WHEN hs.modname IS NOT NULL THEN hs.modname END) AS cm,
    coalesce(fs.qualname, hs.qualname) AS cq,
    q IS NULL OR fs.modname IS NOT NULL OR hs.modname IS NOT NULL AS head_ok
  FROM step LEFT JOIN fin ON fin.modname = step.modname AND fin.member_name = head
  LEFT JOIN sym fs ON fs.modname = fin.target_mod AND fs.qualname = fin.target_qual
  LEFT JOIN sym hs ON hs.modname = step.modname AND hs.qualname = head),
ans AS (SELECT hop.*, m.modname IS NULL AS no_mod, t.qualname AS tq FROM hop LEFT JOIN mods m ON m.modname = hop.modname
  LEFT JOIN sym t ON t.modname = cm AND t.qualname = cq || '.' || tail)
SELECT modname, q AS qualname, CASE WHEN no_mod THEN 'missing_module' WHEN NOT head_ok OR (tail IS NOT NULL AND tq IS NULL)
    THEN 'missing_name' ELSE 'found' END AS status,
  CASE WHEN NOT no_mod AND q IS NULL THEN modname WHEN head_ok AND (tail IS NULL OR tq IS NOT NULL) AND NOT no_mod THEN cm END AS found_mod,
  CASE WHEN NOT no_mod AND head_ok THEN CASE WHEN tail IS NULL THEN cq ELSE tq END END AS found_qual,
  CASE WHEN NOT no_mod AND NOT head_ok THEN head WHEN NOT no_mod AND tail IS NOT NULL AND tq IS NULL THEN q END AS missing_name
FROM ans"""


@query("d04_look_up_through", THROUGH_SQL)
def look_up_through(t):
    return R.look_up_through(_through(t), t.sym(), t.imports())


@query("d05_fetch_status", f"""SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(count(missing_name) AS BIGINT) AS named
FROM ({THROUGH_SQL}) GROUP BY status""")
def fetch_status(t):
    return R.look_up_through(_through(t), t.sym(), t.imports()).groupBy("status").agg(
        F.count("*").alias("n"), F.count("missing_name").alias("named"))


PLACES = """, places AS (SELECT modname, qualname FROM sym UNION ALL SELECT DISTINCT 'builtins', type_qual FROM sym
  UNION ALL SELECT 'pkg', 'asia' UNION ALL SELECT 'pkg', 'europe.N1')"""
ASKED = """, asked AS (SELECT concat_ws('.', modname, qualname) AS name FROM sym
  UNION ALL SELECT modname || ':' || coalesce(qualname, '') FROM sym UNION ALL SELECT type_qual FROM sym
  UNION ALL SELECT concat_ws('.', modname, qualname, 'zz') FROM sym UNION ALL SELECT 'nope:' || name FROM sym
  UNION ALL SELECT 'pkg.europe.N1' FROM region)"""


@query("d06_resolve_names", with_views("sym") + PLACES + ASKED + """, cand AS (
  SELECT a.name, p.modname, p.qualname, length(p.modname) AS rank FROM (SELECT DISTINCT name FROM asked WHERE strpos(name, ':') = 0) a
    JOIN places p ON concat_ws('.', p.modname, p.qualname) = a.name
  UNION ALL SELECT a.name, p.modname, p.qualname, -1 FROM (SELECT DISTINCT name FROM asked WHERE strpos(name, ':') = 0) a
    JOIN places p ON p.modname = 'builtins' AND p.qualname = a.name
  UNION ALL SELECT a.name, p.modname, p.qualname, 0 FROM (SELECT DISTINCT name FROM asked WHERE strpos(name, ':') > 0) a
    JOIN places p ON p.modname = string_split(a.name, ':')[1] AND coalesce(p.qualname, '') = string_split(a.name, ':')[2]),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank DESC) = 1)
SELECT asked.name, best.modname, best.qualname FROM asked LEFT JOIN best USING (name)""")
def resolve_names(t):
    sym = t.sym()
    row = lambda m, q: F.struct(F.lit(m).alias("modname"), F.lit(q).alias("qualname"))
    # Two more places whose full names clash with longer module names.
    clash = t.read("region").groupBy().agg(F.min("r_regionkey")).select(
        F.explode(F.array(row("pkg", "asia"), row("pkg", "europe.N1"))).alias("p")).select("p.*")
    places = (
        sym.select("modname", "qualname")
        .union(sym.select(F.lit("builtins"), "type_qual").distinct()).union(clash)
    )
    full = N.full_name(col("modname"), col("qualname"))
    asked = (
        sym.select(full.alias("name"))
        .union(sym.select(F.concat("modname", F.lit(":"), F.coalesce("qualname", F.lit("")))))
        .union(sym.select("type_qual"))
        .union(sym.select(F.concat(full, F.lit(".zz"))))
        .union(sym.select(F.concat(F.lit("nope:"), "name")))
        .union(t.read("region").select(F.lit("pkg.europe.N1")))
    )
    return R.resolve_names(asked, places).select("name", "modname", "qualname")


@query("d07_exists", with_views("sym", "imports") + """ SELECT i.target_mod AS modname, i.target_qual AS qualname FROM imports i
WHERE EXISTS (SELECT 1 FROM sym s WHERE s.modname = i.target_mod AND s.qualname = i.target_qual)""")
def exists(t):
    paths = t.imports().select(
        col("target_mod").alias("modname"), col("target_qual").alias("qualname"))
    return R.exists(paths, t.sym())


@query("d08_imposters", with_views("sym") + """, obj AS (SELECT concat_ws('.', modname, qualname) AS object_id,
  CASE WHEN type_qual <> 'int' THEN modname END AS cm, CASE WHEN type_qual = 'classmethod' THEN parent_qual || '.' || name || 'x'
  WHEN type_qual = 'staticmethod' THEN parent_qual WHEN type_qual <> 'int' THEN qualname END AS cq FROM sym)
SELECT object_id, CASE WHEN cm IS NULL THEN false ELSE s.modname IS NULL OR concat_ws('.', s.modname, s.qualname) <> object_id END AS is_imposter
FROM obj LEFT JOIN sym s ON s.modname = cm AND s.qualname IS NOT DISTINCT FROM cq""")
def imposters(t):
    object_id = N.full_name(col("modname"), col("qualname"))
    kind = col("type_qual")
    objects = t.sym().select(
        object_id.alias("object_id"),
        F.when(kind != "int", col("modname")).alias("claimed_mod"),
        F.when(kind == "classmethod", F.concat("qualname", F.lit("x")))
        .when(kind == "staticmethod", col("parent_qual"))
        .when(kind != "int", col("qualname")).alias("claimed_qual"))
    places = t.sym().select("modname", "qualname", object_id.alias("object_id"))
    return R.imposters(objects, places).select("object_id", "is_imposter")


@query("d09_really_mangled", with_views("sym") + """, obj AS (SELECT modname AS cm, concat_ws('.', modname, qualname) AS object_id,
  CASE WHEN starts_with(name, '_' || parent_qual || '__') THEN parent_qual || '.' || substr(name, length(parent_qual) + 2)
    ELSE qualname END AS cq, parent_qual FROM sym),
mang AS (SELECT *, CASE WHEN strpos(cq, '.__') > 0 THEN parent_qual || '._' || parent_qual || substr(cq, length(parent_qual) + 2) END AS mq FROM obj)
SELECT object_id, cq AS claimed_qual, coalesce(concat_ws('.', s.modname, s.qualname) = object_id, false) AS is_mangled
FROM mang LEFT JOIN sym s ON s.modname = cm AND s.qualname = mq""")
def really_mangled(t):
    object_id = N.full_name(col("modname"), col("qualname"))
    # Functions report their name as written, so mangled members claim the plain name.
    prefix = F.concat(F.lit("_"), "parent_qual", F.lit("__"))
    written = F.when(
        col("name").startswith(prefix),
        N.child(col("parent_qual"), N.unmangle(col("name"))["name"])).otherwise(col("qualname"))
    objects = t.sym().select(
        object_id.alias("object_id"), col("modname").alias("claimed_mod"),
        written.alias("claimed_qual"))
    places = t.sym().select("modname", "qualname", object_id.alias("object_id"))
    return R.really_mangled(objects, places).select("object_id", "claimed_qual", "is_mangled")


@query("d10_import_edges", with_views("members", "imports") + """ SELECT parent_mod, CAST(NULL AS VARCHAR) AS parent_qual, member_name, target_mod, target_qual FROM (
SELECT modname AS parent_mod, member_name, target_mod, CASE WHEN target_qual = 'missing' THEN NULL ELSE target_qual END AS target_qual FROM imports)
UNION ALL SELECT parent_mod, parent_qual, member_name, parent_mod, 'N0.' || member_name FROM members
WHERE type_qual = 'staticmethod' AND parent_qual <> 'N0'""")
def import_edges(t):
    none = F.lit(None).cast("string")
    gone = col("target_qual") == "missing"
    refs = t.imports().select(
        col("modname").alias("parent_mod"), none.alias("parent_qual"), "member_name",
        col("target_mod").alias("claimed_mod"),
        F.when(~gone, col("target_qual")).alias("claimed_qual"),
        F.when(gone, "module").alias("type_name"))
    moved = col("type_qual") == "staticmethod"
    own = t.members().filter("NOT is_ref").select(
        "parent_mod", "parent_qual", "member_name",
        F.when(col("type_qual") != "int", col("parent_mod")).alias("claimed_mod"),
        F.when(moved, F.concat(F.lit("N0."), "member_name"))
        .otherwise(N.child(col("parent_qual"), col("member_name"))).alias("claimed_qual"),
        col("type_qual").alias("type_name"))
    return R.import_edges(refs.unionByName(own))


# Parts as classes: part k derives from parts k/2 and k/3.
HEIRS = """heirs AS (SELECT p_partkey AS k, concat('m', p_partkey % 7) AS modname, concat('P', p_partkey) AS qualname FROM part)"""


def _heirs(t):
    k = col("p_partkey")

    def ref(n):
        return F.when(n > 0, N.make_ref(F.concat(F.lit("m"), n % 7), F.concat(F.lit("P"), n)))

    bases = F.filter(
        F.array_distinct(F.array(ref(F.floor(k / 2)), ref(F.floor(k / 3)))), lambda r: r.isNotNull())
    return t.read("part").select(
        F.concat(F.lit("m"), k % 7).alias("modname"), F.concat(F.lit("P"), k).alias("qualname"),
        bases.alias("bases"),
        F.concat(F.array(N.make_ref(F.concat(F.lit("m"), k % 7), F.concat(F.lit("P"), k))), bases, F.array(F.lit("#/modules/builtins/dict/object"))).alias("mro"))


BASES_SQL = f"""WITH RECURSIVE {HEIRS}, raw AS (SELECT modname, qualname, 0 AS pos, k // 2 AS b FROM heirs WHERE k >= 2
  UNION ALL SELECT modname, qualname, CASE WHEN k // 2 = k // 3 THEN 0 ELSE 1 END, k // 3 FROM heirs WHERE k >= 3 AND k // 2 <> k // 3),
edge AS (SELECT modname, qualname, CAST(pos AS BIGINT) AS pos, concat('m', b % 7) AS base_mod, concat('P', b) AS base_qual FROM raw)"""


@query("d12_base_edges", BASES_SQL + " SELECT * FROM edge")
def base_edges(t):
    return R.base_edges(_heirs(t))


@query("d13_ancestor_closure", BASES_SQL + """, anc(child, ancestor, depth) AS (
  SELECT modname || '.' || qualname, base_mod || '.' || base_qual, 1 FROM edge
  UNION SELECT anc.child, e.base_mod || '.' || e.base_qual, depth + 1 FROM anc
  JOIN edge e ON e.modname || '.' || e.qualname = anc.ancestor)
SELECT child, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM anc GROUP BY child, ancestor""")
def ancestor_closure(t):
    edges = R.base_edges(_heirs(t)).select(
        N.full_name(col("modname"), col("qualname")).alias("child"),
        N.full_name(col("base_mod"), col("base_qual")).alias("base"))
    return R.ancestor_closure(edges)


@query("d13_mro_text", BASES_SQL + """ SELECT h.modname, h.qualname, h.modname || '.' || h.qualname ||
coalesce((SELECT string_agg(' → ' || base_mod || '.' || base_qual, '' ORDER BY pos) FROM edge e
  WHERE e.modname = h.modname AND e.qualname = h.qualname), '') || ' → object' AS mro FROM heirs h""")
def mro_text(t):
    return _heirs(t).select("modname", "qualname", R.mro_text(col("mro")).alias("mro"))


TAGS = with_views("tags")
TAGGED_SQL = """tv AS (SELECT obj, arg, max_by(text, pos) FILTER (WHERE tag = 'param') AS doc,
  max_by(text, pos) FILTER (WHERE tag = 'type') AS doc_type FROM tags WHERE tag IN ('param', 'type') GROUP BY obj, arg)"""


@query("d14_param_docs", TAGS + f""", {TAGGED_SQL} SELECT p.obj, p.pos, p.name, p.kind, doc, doc_type
FROM params p LEFT JOIN tv ON tv.obj = p.obj AND tv.arg = p.name""")
def param_docs(t):
    return S.attach_to_params(t.params(), t.tags())


@query("d14_unmatched_tags", TAGS + """ SELECT obj, tag, arg, pos FROM tags t WHERE tag IN ('param', 'type')
AND NOT EXISTS (SELECT 1 FROM params p WHERE p.obj = t.obj AND p.name = t.arg)""")
def unmatched_tags(t):
    return S.unmatched_tags(t.params(), t.tags()).select("obj", "tag", "arg", "pos")


RETURNS_SQL = """SELECT obj, max_by(text, pos) FILTER (WHERE tag = 'return') AS doc,
max_by(text, pos) FILTER (WHERE tag = 'rtype') AS doc_type FROM tags WHERE tag IN ('return', 'rtype') GROUP BY obj"""


@query("d15_return_docs", TAGS + " " + RETURNS_SQL)
def return_docs(t):
    return S.attach_returns(t.tags())


@query("d16_exceptions", TAGS + " SELECT obj, pos, arg AS exc_type, text AS doc FROM tags WHERE tag = 'raise'")
def exceptions(t):
    return S.exceptions(t.tags())


SIGNATURE_SQL = """SELECT obj, '(' || string_agg(CASE WHEN kind = 'KEYWORD_ONLY' AND coalesce(stars, 0) = 0 THEN '*, ' ELSE '' END ||
  CASE kind WHEN 'VAR_POSITIONAL' THEN '*' WHEN 'VAR_KEYWORD' THEN '**' ELSE '' END || name, ', ' ORDER BY pos) || ')' AS signature
FROM (SELECT *, count(CASE WHEN kind IN ('VAR_POSITIONAL', 'VAR_KEYWORD', 'KEYWORD_ONLY') THEN 1 END)
  OVER (PARTITION BY obj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stars FROM params) GROUP BY obj"""


@query("d17_signature_tags", with_views("params") + " SELECT obj, pos, name, kind FROM params")
def parsed_signatures(t):
    """Signatures written as `@signature` texts and parsed back to parameters."""
    written = S.signature_texts(t.params()).select(
        "obj", F.lit("signature").alias("tag"), F.lit(1).cast("bigint").alias("pos"),
        F.concat("obj", "signature").alias("text"))
    objects = t.params().select("obj").distinct().withColumn("callable", F.lit(True))
    no_params = t.params().filter("false")
    chosen = S.signature_tags(objects, written, no_params)
    return S.parsed_params(chosen).select("obj", "pos", "name", "kind")


@query("d18_member_docs", with_views("members") + """ SELECT parent_mod || '.' || parent_qual AS obj, member_name,
'newer ' || member_name AS doc FROM members WHERE parent_qual IS NOT NULL AND starts_with(member_name, '_')""")
def member_docs(t):
    owned = t.members().filter("parent_qual IS NOT NULL").select(
        N.full_name(col("parent_mod"), col("parent_qual")).alias("obj"), "member_name")
    every = F.array(
        F.struct(F.lit(1).alias("pos"), F.concat(F.lit("older "), "member_name").alias("text"),
                 col("member_name").alias("arg")),
        F.struct(F.lit(2).alias("pos"), F.concat(F.lit("newer "), "member_name").alias("text"),
                 col("member_name").alias("arg")),
        F.struct(F.lit(3).alias("pos"), F.lit("stray").alias("text"),
                 F.concat("member_name", F.lit("?")).alias("arg")))
    tags = owned.filter(col("member_name").startswith("_")).select(
        "obj", F.lit("cvar").alias("tag"), F.explode(every).alias("x")).select("obj", "tag", "x.*")
    return S.attach_to_members(owned, tags).select("obj", "member_name", "doc")


@query("d19_effective_signature", with_views("objects") + """ SELECT o.modname, o.qualname,
CASE WHEN o.type_name = 'function' THEN '(own)' WHEN f.role IS NOT NULL THEN '(wrapped ' || f.num || ')' END AS signature
FROM objects o LEFT JOIN objects f ON f.role = 'func' AND f.modname = o.modname AND f.qualname = o.qualname WHERE o.role = 'self'""")
def effective_signature(t):
    signed = t.objects().withColumn(
        "signature",
        F.when((col("role") == "self") & (col("type_name") == "function"), F.lit("(own)"))
        .when(col("role") == "func", F.concat(F.lit("(wrapped "), "num", F.lit(")"))))
    joined = M.attach_func(signed, ["signature"])
    return joined.select("modname", "qualname", S.effective_signature(
        col("signature"), col("func_signature")).alias("signature"))


@query("d20_accessors", with_views("objects") + """ SELECT o.modname, o.qualname, w.accessor, CAST(w.pos AS BIGINT) AS pos,
EXISTS (SELECT 1 FROM objects a WHERE a.modname = o.modname AND a.qualname = o.qualname AND a.role = w.accessor) AS present
FROM objects o CROSS JOIN (VALUES ('get', 0), ('set', 1), ('del', 2)) w(accessor, pos) WHERE o.role = 'self' AND o.type_name = 'property'""")
def accessors(t):
    return M.accessors(t.objects()).select("modname", "qualname", "accessor", "pos", "present")


@query("g24_signature_text", with_views("params") + " " + SIGNATURE_SQL)
def signature_text(t):
    return S.signature_texts(t.params())


@query("g25_signature_rows", TAGS + f""", {TAGGED_SQL}, ret AS ({RETURNS_SQL})
SELECT p.obj, CAST(1 AS BIGINT) AS section, p.pos, CASE kind WHEN 'POSITIONAL_OR_KEYWORD' THEN 'right-circled'
  WHEN 'KEYWORD_ONLY' THEN 'cc-nd' WHEN 'VAR_POSITIONAL' THEN 'star' WHEN 'VAR_KEYWORD' THEN 'star-empty' END AS bullet,
  p.name, doc_type, doc FROM params p LEFT JOIN tv ON tv.obj = p.obj AND tv.arg = p.name
UNION ALL SELECT obj, 2, pos, 'alert', arg, NULL, text FROM tags WHERE tag = 'raise'
UNION ALL SELECT obj, 3, 0, 'right-thin', NULL, doc_type, doc FROM ret""")
def signature_rows(t):
    return S.summary_rows(t.params(), t.tags())
