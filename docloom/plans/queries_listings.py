"""Queries that compose member rows, pages and enriched documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import listings as L
from docloom.operators import refs as R
from docloom.operators import signatures as S
from docloom.plans.queries_refs import FOLLOW
from docloom.plans.queries_text import DEDENT, ESCAPED, MARKUP, TAG_SQL
from docloom.plans.registry import query
from docloom.plans.tables import with_views
from docloom.session import spread
from docloom.sources import corpus as K

col = F.col

# Object details: functions take one or two parameters, half of the objects have a body.
DETAIL_SQL = """, detail AS (SELECT modname, qualname, type_qual, name, length(name) % 2 = 0 AS even,
  CASE WHEN type_qual IN ('function', 'staticmethod', 'classmethod') THEN CASE WHEN length(name) % 2 = 0 THEN '(a, *, b)' ELSE '(a)' END END AS signature,
  CASE type_qual WHEN 'property' THEN 'get property' WHEN 'function' THEN 'function' WHEN 'classmethod' THEN 'class method'
    WHEN 'staticmethod' THEN 'static method' WHEN 'getset_descriptor' THEN 'extension property' ELSE type_qual END AS type_label,
  CASE WHEN type_qual NOT IN ('module', 'property', 'type', 'function', 'staticmethod', 'classmethod') THEN '<' || name || '>' END AS repr,
  'about ' || name AS summary,
  CASE type_qual WHEN 'module' THEN 'modules' WHEN 'type' THEN 'types' WHEN 'property' THEN 'properties' WHEN 'function' THEN 'functions'
    WHEN 'staticmethod' THEN 'functions' WHEN 'classmethod' THEN 'functions' ELSE 'attributes' END AS category FROM sym)"""
ROWS_SQL = with_views("members", "imports", recursive=True) + FOLLOW + DETAIL_SQL + """, mem AS (
  SELECT modname AS parent_mod, parent_qual, name AS member_name, false AS is_ref, CAST(NULL AS VARCHAR) AS t_mod, CAST(NULL AS VARCHAR) AS t_qual,
    modname AS at_mod, qualname AS at_qual FROM sym WHERE qualname IS NOT NULL
  UNION ALL SELECT i.modname, NULL, i.member_name, true, i.target_mod, i.target_qual, fin.target_mod, fin.target_qual
  FROM imports i JOIN fin ON fin.modname = i.modname AND fin.member_name = i.member_name),
rows AS (SELECT parent_mod, parent_qual, member_name, is_ref,
  CASE WHEN mangled THEN substr(rest, strpos(rest, '__')) ELSE member_name END AS plain_name,
  CASE WHEN mangled THEN substr(rest, 1, strpos(rest, '__') - 1) END AS mangled_for, signature, type_label,
  CASE WHEN is_ref THEN CASE WHEN t_mod = parent_mod THEN t_qual ELSE t_mod || '.' || t_qual END END AS import_path,
  repr, summary, coalesce(even, false) AS has_more, coalesce(category, 'attributes') AS category
FROM (SELECT *, substr(member_name, 2) AS rest, starts_with(member_name, '_') AND NOT starts_with(member_name, '__')
    AND strpos(substr(member_name, 2), '__') > 0 AS mangled FROM mem) m
  LEFT JOIN detail d ON d.modname = at_mod AND d.qualname IS NOT DISTINCT FROM at_qual)"""


def _details(t):
    even, kind = F.length("name") % 2 == 0, col("type_qual")
    signed = kind.isin("function", "staticmethod", "classmethod")

    def param(pos, name, how):
        return F.struct(F.lit(pos).cast("bigint").alias("pos"), F.lit(name).alias("name"), F.lit(how).alias("kind"))

    first, second = param(1, "a", "POSITIONAL_OR_KEYWORD"), param(2, "b", "KEYWORD_ONLY")
    return t.sym().select(
        "modname", "qualname", F.lit("builtins").alias("type_mod"), "type_qual",
        kind.alias("type_name"), "name", F.lit(True).alias("has_get"),
        F.lit(False).alias("has_set"), F.lit(False).alias("has_del"),
        F.when(signed & even, F.array(first, second)).when(signed, F.array(first)).alias("params"),
        signed.alias("function_like"),
        F.concat(F.lit("<"), "name", F.lit(">")).alias("repr"),
        F.concat(F.lit("about "), "name").alias("summary"),
        F.when(even, "more").otherwise("").alias("body"))


def _placed_members(t):
    none = F.lit(None).cast("string")
    own = t.members().filter("NOT is_ref").select(
        "parent_mod", "parent_qual", "member_name", "is_ref",
        none.alias("target_mod"), none.alias("target_qual"))
    refs = t.imports().select(
        col("modname").alias("parent_mod"), none.alias("parent_qual"), "member_name",
        F.lit(True).alias("is_ref"), "target_mod", "target_qual")
    return own.unionByName(refs)


@query("g26_member_rows", ROWS_SQL + " SELECT * FROM rows")
def member_rows(t):
    return L.member_rows(_placed_members(t), _details(t))


@query("g27_page_rows", ROWS_SQL + """
SELECT modname, qualname, CAST(0 AS BIGINT) AS section, 'Head' AS title, '' AS key,
  '{"name":"' || name || '"' || coalesce(',"qualname":"' || qualname || '"', '') || ',"modname":"' || modname || '","type_name":"' || type_qual || '","repr":"<' || name || '>"}' AS json FROM sym
UNION ALL SELECT modname, qualname, 2, 'Documentation', '', '{"summary":"about ' || name || '","body":"' || CASE WHEN length(name) % 2 = 0 THEN 'more' ELSE '' END || '"}' FROM sym
UNION ALL SELECT modname, qualname, 3, 'Type', lpad('0', 19, '0'), '{"base_mod":"builtins","base_qual":"object"}' FROM sym WHERE type_qual = 'type'
UNION ALL SELECT modname, qualname, 4, 'Parameters', '1.' || lpad(CAST(p AS VARCHAR), 19, '0'),
  '{"part":1,"bullet":"' || CASE p WHEN 1 THEN 'right-circled' ELSE 'cc-nd' END || '","name":"' || CASE p WHEN 1 THEN 'a' ELSE 'b' END || '"}' FROM detail, (VALUES (1), (2)) v(p)
  WHERE signature IS NOT NULL AND (p = 1 OR even)
UNION ALL SELECT parent_mod, parent_qual, CASE category WHEN 'modules' THEN 5 WHEN 'types' THEN 6 WHEN 'properties' THEN 7 WHEN 'functions' THEN 8 ELSE 9 END,
  CASE category WHEN 'modules' THEN 'Modules' WHEN 'types' THEN CASE WHEN parent_qual IS NULL THEN 'Types' ELSE 'Member Types' END
    WHEN 'properties' THEN 'Properties' WHEN 'functions' THEN CASE WHEN parent_qual IS NULL THEN 'Functions' ELSE 'Methods' END ELSE 'Attributes' END,
  member_name, '{"plain_name":"' || plain_name || '"' || coalesce(',"signature":"' || signature || '"', '') || coalesce(',"type_label":"' || type_label || '"', '')
  || coalesce(',"import_path":"' || import_path || '"', '') || coalesce(',"repr":"' || repr || '"', '') || coalesce(',"summary":"' || summary || '"', '')
  || ',"has_more":' || has_more || '}' FROM rows""")
def page_rows(t):
    details = _details(t)
    bases = R.base_edges(details.filter("type_qual = 'type'").select(
        "modname", "qualname", F.array(F.lit("#/modules/builtins/dict/object")).alias("bases")))
    signed = details.select("modname", "qualname", F.explode("params").alias("p")).select(
        "modname", "qualname", F.lit(1).cast("bigint").alias("section"), "p.pos",
        S.bullet_for(col("p.kind")).alias("bullet"), "p.name",
        F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("doc"))
    rows = L.member_rows(_placed_members(t), details)
    return L.page_rows(details, rows, signed, bases)


def _boxes(t):
    """A module around every document; its class follows that of the document with half the number."""
    i, n = col("doc_id").cast("string"), col("n_chars").cast("string")
    source = F.concat(
        F.lit('"""About '), "lang", F.lit('."""\nfrom box.m'), F.floor(col("doc_id") / 2).cast("string"),
        F.lit(' import Box as Base\n__all__ = ("Box", "run")\nclass Box(Base):\n    """A box."""\n    size = '), n,
        F.lit("\n    far = Base."), F.when(col("doc_id") == 0, "make").otherwise("far"),
        F.lit('\n    def make(self, a: Base, *, b=2):\n        """Makes it.\n\n        @param a  first of '), i,
        F.lit('\n        """\nrun = Box.make\ndef _hidden(x, y): pass\n'))
    return spread(t.read("documents"), "doc_id").select(
        F.concat(F.lit("box.m"), i).alias("modname"), F.concat(F.lit("box/m"), i, F.lit(".py")).alias("path"), source.alias("source"))


def _page(q, section, title, key, json):
    return f"{{'q': {q}, 's': {section}, 't': '{title}', 'k': '{key}', 'j': {json}}}"


def _boxes_sql():
    """The pages that every module of `_boxes` has, one struct a row."""
    base = "CASE WHEN doc_id = 0 THEN '{0}' ELSE 'box.m' || (doc_id // 2) || '.{0}' END"
    made = '"signature":"(self, a, *, b)","type_label":"function"'
    told = ',"summary":"Makes it.","has_more":false}'
    first, plain = '{"part":1,"bullet":"right-circled","name":"', "000000000000000000"
    led = "'{\"plain_name\":\"%s\",%s,\"import_path\":\"' || %s || '\"%s'"
    return ", ".join([
        _page("NULL", 0, "Head", "", """'{"name":"box.m' || doc_id || '","modname":"box.m' || doc_id || '","type_name":"module"}'"""),
        _page("NULL", 2, "Documentation", "", """'{"summary":"About ' || lang || '.","body":""}'"""),
        _page("NULL", 6, "Types", "Base", led % ("Base", '"type_label":"type"', base.format("Box"), ',"summary":"A box.","has_more":false}')),
        _page("NULL", 6, "Types", "Box", """'{"plain_name":"Box","type_label":"type","summary":"A box.","has_more":false}'"""),
        _page("NULL", 8, "Functions", "_hidden", """'{"plain_name":"_hidden","signature":"(x, y)","type_label":"function","has_more":false}'"""),
        _page("NULL", 8, "Functions", "run", led % ("run", made, "'Box.make'", told)),
        _page("'Box'", 0, "Head", "", """'{"name":"Box","qualname":"Box","modname":"box.m' || doc_id || '","type_name":"type"}'"""),
        _page("'Box'", 2, "Documentation", "", """'{"summary":"A box.","body":""}'"""),
        _page("'Box'", 3, "Type", plain + "0", """'{"base_mod":"box.m' || (doc_id // 2) || '","base_qual":"Box"}'"""),
        _page("'Box'", 8, "Methods", "far", led % ("far", made, base.format("Box.far").replace("'Box.far'", "'Box.make'"), told)),
        _page("'Box'", 8, "Methods", "make", f"""'{{"plain_name":"make",{made}{told}'"""),
        _page("'Box'", 9, "Attributes", "size", """'{"plain_name":"size","type_label":"int","repr":"' || n_chars || '","has_more":false}'"""),
        _page("'Box.make'", 0, "Head", "", """'{"name":"make","qualname":"Box.make","modname":"box.m' || doc_id || '","type_name":"function"}'"""),
        _page("'Box.make'", 2, "Documentation", "", """'{"summary":"Makes it.","body":""}'"""),
        _page("'Box.make'", 4, "Parameters", f"1.{plain}1", f"""'{first}self"}}'"""),
        _page("'Box.make'", 4, "Parameters", f"1.{plain}2", f"""'{first}a","doc_type":"' || {base.format("Box")} || '","doc":"first of ' || doc_id || '\\n"}}'"""),
        _page("'Box.make'", 4, "Parameters", f"1.{plain}3", """'{"part":1,"bullet":"cc-nd","name":"b"}'"""),
        _page("'Box.size'", 0, "Head", "", """'{"name":"size","qualname":"Box.size","modname":"box.m' || doc_id || '","type_name":"int","repr":"' || n_chars || '"}'"""),
        _page("'_hidden'", 0, "Head", "", """'{"name":"_hidden","qualname":"_hidden","modname":"box.m' || doc_id || '","type_name":"function"}'"""),
        _page("'_hidden'", 4, "Parameters", f"1.{plain}1", f"""'{first}x"}}'"""),
        _page("'_hidden'", 4, "Parameters", f"1.{plain}2", f"""'{first}y"}}'"""),
    ])


@query("g27_source_pages", f"""SELECT 'box.m' || doc_id AS modname, r.q AS qualname, CAST(r.s AS BIGINT) AS section, r.t AS title, r.k AS key, r.j AS json
FROM (SELECT doc_id, unnest([{_boxes_sql()}]) AS r FROM documents)""")
def source_pages(t):
    """Pages as JSON from nothing but source texts."""
    return K.pages(K.build(_boxes(t)))


FIRST_PAR = MARKUP.format(ESCAPED.format("array_to_string(list_transform(string_split(par, chr(10)), lambda l: ltrim(l)), ' ')"))


@query("g28_enrich", DEDENT + TAG_SQL.replace("{src}", "flat") + f""",
joined AS (SELECT doc_id, string_agg(CASE WHEN trim(line) = '' THEN '' ELSE line END, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id),
firsts AS (SELECT doc_id, string_split_regex(regexp_replace(text, '^\\n+', ''), '\\n\\n+')[1] AS par FROM joined)
SELECT d.doc_id, CASE WHEN par <> '' AND NOT regexp_matches(par, '^( {{4}}|\\t|#{{1,6}}[^#\\n]|```|>>> | {{0,3}}[-*+] | {{0,3}}[0-9]+\\. )') AND NOT regexp_matches(par, '^[^\\n]+\\n(=+|-+) *(\\n|$)') THEN {FIRST_PAR} END AS summary,
  p2, p11, given, coalesce(n_unmatched, 0) AS n_unmatched
FROM docstr d LEFT JOIN firsts f ON f.doc_id = d.doc_id LEFT JOIN (
  SELECT doc_id, max_by(text, no) FILTER (WHERE tag = 'param' AND arg = 'p2') AS p2, max_by(text, no) FILTER (WHERE tag = 'param' AND arg = 'p11') AS p11,
    max_by(text, no) FILTER (WHERE tag = 'return') AS given,
    count(*) FILTER (WHERE tag = 'param' AND (arg IS NULL OR arg NOT IN ('p2', 'p11'))) AS n_unmatched FROM found GROUP BY doc_id) x ON x.doc_id = d.doc_id""")
def enrich(t):
    push = F.repeat(F.lit(" "), (col("doc_id") % 5).cast("int"))
    pushed = F.transform(F.split("text", "\n"), lambda l, i: F.concat(
        F.when(i == 0, F.lit(" ")).otherwise(push), l))
    params = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.lit("KEYWORD_ONLY").alias("kind"))
        for i, n in enumerate(("p2", "p11"))])
    objects = t.docstr().select(
        "doc_id", F.array_join(pushed, "\n").alias("doc"), params.alias("params"))
    d = col("documented")
    return L.enrich(objects).select(
        "doc_id", "docs.summary", d["params"][0]["doc"].alias("p2"), d["params"][1]["doc"].alias("p11"),
        d["return_doc"].alias("given"), F.size(d["unmatched"]).cast("bigint").alias("n_unmatched"))
