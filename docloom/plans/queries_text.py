"""Queries that segment docstrings; every document is read whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.generate import explode_rows
from docloom.plans.registry import query
from docloom.plans.tables import lines_of, with_views

col = F.col
LINES = with_views("docstr_lines")
RLINES = with_views("docstr_lines", recursive=True)

IND = "length({0}) - length(ltrim({0}, ' '))"
BLANK = "trim({0}) = ''"


def _lines(t):
    return t.docstr().select("doc_id", F.split("text", "\n").alias("lines"))


def _exploded(df, column, *names):
    """Rows of an array of structs."""
    fields = [col(f"_x.{n}").alias(n) for n in names]
    return explode_rows(df, ["doc_id"], col(column), "_x", pos="no").select("doc_id", "no", *fields)


@query("g01_indent", LINES + f""" SELECT doc_id, line_no, CAST({IND.format('line')} AS BIGINT) AS indent,
CAST(CASE WHEN trim(line, ' ') <> '' THEN {IND.format('line')} END AS BIGINT) AS block_indent FROM docstr_lines""")
def indent(t):
    return lines_of(t.docstr()).select(
        "doc_id", "line_no", X.indent(col("line")).cast("bigint").alias("indent"),
        X.block_indent(col("line")).cast("bigint").alias("block_indent"))


# Lines pushed right by an amount that differs between documents.
PUSHED = LINES + f""", pushed AS (SELECT doc_id, line_no, l AS line, {BLANK.format('l')} AS blank, {IND.format('l')} AS ind FROM (
  SELECT doc_id, line_no, CASE WHEN line_no = 0 THEN ' ' || line ELSE repeat(' ', CAST(doc_id % 5 AS INTEGER)) || line END AS l
  FROM docstr_lines))"""


def _pushed(t):
    push = F.repeat(F.lit(" "), (col("doc_id") % 5).cast("int"))
    return _lines(t).withColumn("lines", F.transform(
        "lines", lambda l, i: F.concat(F.when(i == 0, F.lit(" ")).otherwise(push), l)))


@query("g02_remove_indent", PUSHED + """, base AS (SELECT doc_id, min(ind) FILTER (WHERE NOT blank) AS n FROM pushed GROUP BY doc_id)
SELECT doc_id, string_agg(CASE WHEN blank THEN line ELSE substr(line, n + 1) END, chr(10) ORDER BY line_no) AS text
FROM pushed JOIN base USING (doc_id) GROUP BY doc_id""")
def remove_indent(t):
    return _pushed(t).select(
        "doc_id", F.array_join(X.remove_indent(col("lines")), "\n").alias("text"))


@query("g03_common_indent", PUSHED + """, base AS (SELECT doc_id, count(*) AS k,
  coalesce(min(ind) FILTER (WHERE NOT blank), 0) AS every, coalesce(min(ind) FILTER (WHERE NOT blank AND line_no > 0), 0) AS later
  FROM pushed GROUP BY doc_id),
n AS (SELECT doc_id, CASE WHEN k > 1 THEN later ELSE every END AS n FROM base)
SELECT doc_id, CAST(n AS BIGINT) AS indent, string_agg(substr(line, CASE WHEN line_no = 0 THEN least(n, ind) ELSE n END + 1), chr(10) ORDER BY line_no) AS text
FROM pushed JOIN n USING (doc_id) GROUP BY doc_id, n""")
def common_indent(t):
    cut = X.cut_indent(col("lines"), ignore_first=True)
    return _pushed(t).select("doc_id", cut.alias("c")).select(
        "doc_id", col("c.indent").cast("bigint").alias("indent"),
        F.array_join("c.lines", "\n").alias("text"))


PARS = f""", pars AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS no, text, n_lines FROM (
  SELECT doc_id, g, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n_lines FROM (
    SELECT *, sum(CASE WHEN {BLANK.format('line')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM docstr_lines)
  WHERE NOT {BLANK.format('line')} GROUP BY doc_id, g))"""


@query("g04_paragraphs", LINES + PARS + " SELECT doc_id, no, text FROM pars")
def paragraphs(t):
    return explode_rows(_lines(t), ["doc_id"], X.paragraphs(col("lines")), "text", pos="no")


@query("g05_normal_lines", """SELECT doc_id, string_agg(rtrim(array_to_string(list_transform(p, lambda x, i: CASE WHEN i < len(p)
  THEN x || repeat(' ', CAST(8 - length(x) % 8 AS INTEGER)) ELSE x END), '')), chr(10) ORDER BY i) AS text FROM (
SELECT doc_id, i, string_split(replace(line, ', ', ',' || chr(9)) || '  ', chr(9)) AS p FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents))
GROUP BY doc_id""")
def normal_lines(t):
    tabbed = F.regexp_replace(F.replace("text", F.lit(", "), F.lit(",\t")), r"(\n|\z)", "  $1")
    return t.docs().select(
        "doc_id", F.array_join(X.normal_lines(tabbed), "\n").alias("text"))


WORD = "regexp_extract({0}, '^\\s*(\\S+)', 1)"
MARKUP = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '``([^\\n]+?)``', '<code>\\1</code>', 'g'), '`([^\\n]+?)`', '<code>\\1</code>', 'g'),
  '(\\s)_(\\S[^\\n]{{0,128}}\\S)_(\\s)', '\\1<i>\\2</i>\\3', 'g'),
  '(\\s)\\*\\*(\\S[^\\n]{{0,128}}\\S)\\*\\*(\\s)', '\\1<b>\\2</b>\\3', 'g'),
  '(\\s)\\*(\\S[^\\n]{{0,128}}\\S)\\*(\\s)', '\\1<i>\\2</i>\\3', 'g')"""
TAG_SQL = f""", marked AS (SELECT *, {WORD.format('line')} LIKE '@_%' AS is_tag, {IND.format('line')} AS ind FROM {{src}}),
run AS (SELECT *, sum(CASE WHEN is_tag THEN 1 ELSE 0 END) OVER w AS k, last_value(CASE WHEN is_tag THEN ind END IGNORE NULLS) OVER w AS tag_ind
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
body AS (SELECT *, NOT is_tag AND k > 0 AND ind >= tag_ind AS more FROM run),
head AS (SELECT doc_id, k, substr({WORD.format('line')}, 2) AS tag,
  trim(regexp_replace(line, '^\\s*\\S+', '')) AS rest FROM body WHERE is_tag),
opened AS (SELECT *, tag IN ('cvar', 'ivar', 'param', 'raise', 'raises', 'type', 'var') AND rest <> '' AS takes FROM head),
lead_in AS (SELECT doc_id, k, tag, CASE WHEN takes THEN regexp_extract(rest, '^\\S+') END AS arg,
  CASE WHEN takes THEN regexp_replace(rest, '^\\S+\\s*', '') ELSE rest END AS opening FROM opened),
conts AS (SELECT doc_id, k, string_agg(trim(line), chr(10) ORDER BY line_no) AS more FROM body WHERE more GROUP BY doc_id, k),
found AS (SELECT l.doc_id, k - 1 AS no, tag, arg, {MARKUP.format("CASE WHEN opening <> '' AND more IS NOT NULL THEN opening || chr(10) || more WHEN opening <> '' THEN opening ELSE coalesce(more, '') END")} AS text
  FROM lead_in l LEFT JOIN conts USING (doc_id, k)),
kept AS (SELECT doc_id, line_no, line FROM body WHERE NOT is_tag AND NOT more)"""


@query("g06_tags", LINES + TAG_SQL.replace("{src}", "docstr_lines") + " SELECT doc_id, CAST(no AS BIGINT) AS no, tag, arg, text FROM found")
def tags(t):
    split = _lines(t).select("doc_id", X.split_tags(col("lines"))["tags"].alias("tags"))
    return _exploded(split, "tags", "tag", "arg", "text")


@query("g06_doc_lines", LINES + TAG_SQL.replace("{src}", "docstr_lines") + """ SELECT d.doc_id, coalesce(k.text, '') AS text, coalesce(n, 0) AS n FROM docstr d
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n FROM kept GROUP BY doc_id) k ON k.doc_id = d.doc_id""")
def doc_lines(t):
    split = _lines(t).select("doc_id", X.split_tags(col("lines"))["doc_lines"].alias("l"))
    return split.select("doc_id", F.array_join("l", "\n").alias("text"), F.size("l").cast("bigint").alias("n"))


@query("g07_unknown_tags", LINES + TAG_SQL.replace("{src}", "(SELECT doc_id, line_no, replace(line, '@return ', '@returns ') AS line FROM docstr_lines)") + """
SELECT tag, CAST(count(*) AS BIGINT) AS n FROM found
WHERE tag NOT IN ('cvar', 'param', 'raise', 'return', 'rtype', 'signature', 'type') GROUP BY tag""")
def unknown_tags(t):
    renamed = F.split(F.replace("text", F.lit("@return "), F.lit("@returns ")), "\n")
    found = explode_rows(t.docstr(), [], X.split_tags(renamed)["tags"], "x").select("x.tag")
    return found.filter(~col("tag").isin(*X.KNOWN_TAGS)).groupBy("tag").agg(F.count("*").alias("n"))


@query("g08_inline_markup", with_views("docstr") + f" SELECT doc_id, {MARKUP.format('text')} AS text FROM docstr")
def inline_markup(t):
    return t.docstr().select("doc_id", X.inline_markup(col("text")).alias("text"))


ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')"""


@query("g09_escape_html", f"SELECT page_id, {ESCAPED.format('html')} AS text FROM pages")
def escape_html(t):
    return t.read("pages").select("page_id", X.escape_html(col("html")).alias("text"))


SUMMARY = MARKUP.format(ESCAPED.format("array_to_string(list_transform(string_split(text, chr(10)), lambda l: ltrim(l)), ' ')"))


@query("g10_summary", LINES + PARS + f" SELECT d.doc_id, summary FROM docstr d LEFT JOIN (SELECT doc_id, {SUMMARY} AS summary FROM pars WHERE no = 0) s ON s.doc_id = d.doc_id")
def summary(t):
    return _lines(t).select("doc_id", X.summary(col("lines")).alias("summary"))


BLOCKS_SQL = RLINES + PARS + """, shaped AS (SELECT doc_id, no, min(ind) AS ind, string_agg(substr(l, ind_min + 1), chr(10) ORDER BY i) AS text FROM (
  SELECT *, min(ind) OVER (PARTITION BY doc_id, no) AS ind_min FROM (
    SELECT doc_id, no, i, l, length(l) - length(ltrim(l, ' ')) AS ind FROM (
      SELECT doc_id, no, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM pars WHERE no > 0)))
  GROUP BY doc_id, no),
par AS MATERIALIZED (SELECT *, starts_with(text, '>>>') AS test, regexp_matches(text, ':\\s*$') AS colon FROM shaped),
fold AS (
  SELECT doc_id, no, ind AS base, NOT test AND colon AS inside, CASE WHEN test THEN 'd' ELSE 'p' END AS label, 1 AS block FROM par WHERE no = 1
  UNION ALL
  SELECT p.doc_id, p.no, CASE WHEN f.inside AND p.ind > f.base THEN f.base ELSE p.ind END,
    (f.inside AND p.ind > f.base) OR (NOT p.test AND p.colon),
    CASE WHEN f.inside AND p.ind > f.base THEN 'c' WHEN p.test THEN 'd' ELSE 'p' END,
    f.block + CASE WHEN f.inside AND p.ind > f.base AND f.label = 'c' THEN 0 ELSE 1 END
  FROM fold f JOIN par p ON p.doc_id = f.doc_id AND p.no = f.no + 1)"""


@query("g11_body_blocks", BLOCKS_SQL + f""" SELECT doc_id, CAST(block - 1 AS BIGINT) AS no,
CASE min(label) WHEN 'c' THEN 'code' WHEN 'd' THEN 'doctest' ELSE 'text' END AS kind,
CASE min(label) WHEN 'c' THEN {ESCAPED.format("string_agg(text || chr(10), chr(10) ORDER BY no)")} WHEN 'd' THEN min(text)
  ELSE min({MARKUP.format(ESCAPED.format("replace(text, chr(10), ' ')"))}) END AS text
FROM fold JOIN par USING (doc_id, no) GROUP BY doc_id, block""")
def body_blocks(t):
    cut = _lines(t).select("doc_id", X.body_blocks(col("lines")).alias("b"))
    return _exploded(cut, "b", "kind", "text")


# The whole docstring path: dedent below line one, then split the tags off.
DEDENT = PUSHED + """, least_ind AS (SELECT doc_id, coalesce(CASE WHEN count(*) > 1 THEN min(ind) FILTER (WHERE NOT blank AND line_no > 0)
  ELSE min(ind) FILTER (WHERE NOT blank) END, 0) AS n FROM pushed WHERE true GROUP BY doc_id),
flat AS (SELECT doc_id, line_no, substr(line, CASE WHEN line_no = 0 THEN least(n, ind) ELSE n END + 1) AS line
  FROM pushed_lines JOIN least_ind USING (doc_id))"""
# A final line break opens no further line.
DEDENT = DEDENT.replace("), least_ind", "), pushed_lines AS (SELECT * FROM pushed p WHERE NOT (p.line = '' AND p.line_no > 0 AND p.line_no = (SELECT max(line_no) FROM docstr_lines d WHERE d.doc_id = p.doc_id))), least_ind").replace("FROM pushed WHERE true", "FROM pushed_lines")


@query("g12_normal_doc", DEDENT + TAG_SQL.replace("{src}", "flat") + """ SELECT d.doc_id, coalesce(k.text, '') AS doc, coalesce(n, 0) AS n_tags FROM docstr d
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) f ON f.doc_id = d.doc_id""")
def normal_doc(t):
    text = _pushed(t).select("doc_id", F.array_join("lines", "\n").alias("text"))
    return text.select("doc_id", X.normalise_doc(col("text")).alias("d")).select(
        "doc_id", F.array_join("d.doc_lines", "\n").alias("doc"),
        F.size("d.tags").cast("bigint").alias("n_tags"))


DOCTEST_SQL = RLINES + f""", l AS MATERIALIZED (SELECT *, {IND.format('line')} AS ind, regexp_matches(line, '^ *>>> ') AS prompt, {BLANK.format('line')} AS blank FROM docstr_lines),
fold AS (
  SELECT doc_id, line_no, line, CASE WHEN prompt THEN ind ELSE 0 END AS base, CASE WHEN prompt THEN 1 ELSE 0 END AS mode,
    CASE WHEN prompt THEN 'S' ELSE '-' END AS label, CASE WHEN prompt THEN 1 ELSE 0 END AS example FROM l WHERE line_no = 0
  UNION ALL
  SELECT l.doc_id, l.line_no, l.line, CASE WHEN c.label = 'S' THEN l.ind ELSE f.base END,
    CASE c.label WHEN 'S' THEN 1 WHEN 'C' THEN 1 WHEN 'O' THEN 2 ELSE 0 END, c.label, f.example + CASE WHEN c.label = 'S' THEN 1 ELSE 0 END
  FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.line_no = f.line_no + 1, LATERAL (SELECT CASE
    WHEN f.mode = 1 AND l.ind >= f.base AND starts_with(substr(l.line, f.base + 1), '... ') THEN 'C'
    WHEN f.mode > 0 AND l.ind >= f.base AND NOT l.blank AND NOT starts_with(substr(l.line, f.base + 1), '>>>') THEN 'O'
    WHEN l.prompt THEN 'S' ELSE '-' END AS label) c)"""


@query("g13_doctests", DOCTEST_SQL + """ SELECT doc_id, CAST(example - 1 AS BIGINT) AS no,
string_agg(substr(line, base + 5), chr(10) ORDER BY line_no) FILTER (WHERE label IN ('S', 'C')) AS source,
coalesce(string_agg(substr(line, base + 1), chr(10) ORDER BY line_no) FILTER (WHERE label = 'O'), '') AS output
FROM fold WHERE label <> '-' GROUP BY doc_id, example""")
def doctests(t):
    found = _lines(t).select("doc_id", X.doctests(col("lines")).alias("e"))
    return _exploded(found, "e", "source", "output")


# Every second line becomes a bullet, with indentation and bullet changing now and then.
BULLETED = """, bulleted AS MATERIALIZED (SELECT doc_id, line_no, CASE line_no % 7 WHEN 0 THEN '- ' || line WHEN 2 THEN '  cont ' || line
  WHEN 3 THEN '- ' || line WHEN 4 THEN '  * ' || line WHEN 6 THEN '* ' || line ELSE line END AS line FROM docstr_lines)"""


def _bulleted(t):
    def mark(line, i):
        k = i % 7
        lead = (
            F.when(k.isin(0, 3), "- ").when(k == 2, "  cont ").when(k == 4, "  * ")
            .when(k == 6, "* ").otherwise(""))
        return F.concat(lead, line)

    return _lines(t).withColumn("lines", F.transform("lines", mark))


BULLET_RE = "'^( *)([-*]) *([^\\n]*)$'"


@query("g14_bullets", LINES + BULLETED + f""" SELECT doc_id, line_no, CASE WHEN regexp_matches(line, {BULLET_RE}) THEN regexp_extract(line, {BULLET_RE}, 2) END AS bullet,
CASE WHEN regexp_matches(line, {BULLET_RE}) THEN regexp_replace(line, {BULLET_RE}, '\\1\\3') ELSE line END AS text FROM bulleted""")
def bullets(t):
    text = _bulleted(t).select("doc_id", F.array_join("lines", "\n").alias("text"))
    b = X.bullet(col("line"))
    return lines_of(text).select(
        "doc_id", "line_no", b["bullet"].alias("bullet"), b["text"].alias("text"))


LIST_SQL = RLINES + BULLETED + f""", l AS MATERIALIZED (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, {BULLET_RE}) THEN regexp_extract(line, {BULLET_RE}, 2) END AS b,
  CASE WHEN trim(line, ' ') <> '' THEN {IND.format('line')} END AS ind, trim(line, ' ') = '' AS empty FROM bulleted),
fold AS (
  SELECT doc_id, line_no, b IS NOT NULL AS is_open, ind AS base, b AS bullet, empty, CASE WHEN b IS NOT NULL THEN 'L' ELSE '-' END AS label,
    CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END AS list_no, 0 AS item_no FROM l WHERE line_no = 0
  UNION ALL
  SELECT l.doc_id, l.line_no, c.still OR l.b IS NOT NULL, CASE WHEN d.label = 'L' THEN l.ind ELSE f.base END, CASE WHEN d.label = 'L' THEN l.b ELSE f.bullet END,
    l.empty, d.label, f.list_no + CASE WHEN d.label = 'L' THEN 1 ELSE 0 END, CASE d.label WHEN 'L' THEN 0 WHEN 'I' THEN f.item_no + 1 ELSE f.item_no END
  FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.line_no = f.line_no + 1,
  LATERAL (SELECT f.is_open AND NOT (coalesce(l.ind < f.base, false) OR coalesce(l.b <> f.bullet, false)
    OR (f.empty AND l.b IS NULL AND coalesce(l.ind = f.base, false))) AS still) c,
  LATERAL (SELECT CASE WHEN l.b IS NOT NULL AND NOT c.still THEN 'L' WHEN l.b IS NOT NULL AND c.still AND l.ind = f.base THEN 'I'
    WHEN c.still THEN 'C' ELSE '-' END AS label) d)"""


@query("g15_bullet_lists", LIST_SQL + f""" SELECT doc_id, CAST(list_no - 1 AS BIGINT) AS list_no, CAST(item_no AS BIGINT) AS item_no,
string_agg(CASE WHEN label = 'C' THEN line ELSE regexp_replace(line, {BULLET_RE}, '\\1\\3') END, chr(10) ORDER BY line_no) AS text
FROM fold JOIN l USING (doc_id, line_no) WHERE label <> '-' GROUP BY doc_id, list_no, item_no""")
def bullet_lists(t):
    lists = explode_rows(
        _bulleted(t), ["doc_id"], X.bullet_lists(col("lines")), "items", pos="list_no")
    return explode_rows(lists, ["doc_id", "list_no"], col("items"), "i", pos="item_no").select(
        "doc_id", "list_no", "item_no", "i.text")


@query("g16_paragraph_blocks", LINES + PARS + " SELECT doc_id, no, n_lines FROM pars")
def paragraph_blocks(t):
    return paragraphs(t).select(
        "doc_id", "no", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))


@query("g17_indent_groups", LINES + f""", l AS (SELECT *, coalesce(b, false) AS base, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY line_no), line_no = 0) AS was FROM (
  SELECT *, coalesce(ind = min(ind) OVER (PARTITION BY doc_id), false) AS b FROM (
    SELECT *, CASE WHEN trim(line, ' ') <> '' THEN {IND.format('line')} END AS ind FROM docstr_lines))),
g AS (SELECT *, sum(CASE WHEN base OR was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS no, CASE WHEN bool_or(base) THEN 'LINE' ELSE 'DIV' END AS kind,
string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY doc_id, k""")
def indent_groups(t):
    cut = _lines(t).select("doc_id", X.indent_groups(col("lines")).alias("b"))
    return _exploded(cut, "b", "kind", "text")


@query("g18_blocks", RLINES + f""", l AS MATERIALIZED (SELECT *, ind IS NULL AS blank, coalesce(ind = min(ind) OVER (PARTITION BY doc_id), false) AS base FROM (
  SELECT *, CASE WHEN trim(line, ' ') <> '' THEN {IND.format('line')} END AS ind FROM docstr_lines)),
fold AS (
  SELECT doc_id, line_no, CASE WHEN blank THEN '-' WHEN base THEN 'P' ELSE 'D' END AS label, CASE WHEN blank THEN 0 ELSE 1 END AS k FROM l WHERE line_no = 0
  UNION ALL
  SELECT l.doc_id, l.line_no, c.label, f.k + CASE WHEN c.label IN ('P', 'D') THEN 1 ELSE 0 END
  FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.line_no = f.line_no + 1, LATERAL (SELECT CASE
    WHEN l.blank AND lower(f.label) = 'd' THEN 'd' WHEN l.blank THEN '-' WHEN l.base AND lower(f.label) = 'p' THEN 'p'
    WHEN l.base THEN 'P' WHEN lower(f.label) = 'd' THEN 'd' ELSE 'D' END AS label) c)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS no, CASE WHEN starts_with(string_agg(line, chr(10) ORDER BY line_no), '>>> ') THEN 'DOCTEST'
  WHEN bool_or(label = 'P') THEN 'P' ELSE 'DIV' END AS kind, string_agg(line, chr(10) ORDER BY line_no) AS text
FROM fold JOIN l USING (doc_id, line_no) WHERE label <> '-' GROUP BY doc_id, k""")
def blocks(t):
    cut = _lines(t).select("doc_id", X.blocks(col("lines")).alias("b"))
    return _exploded(cut, "b", "kind", "text")


@query("g19_elide", """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l:
CASE WHEN length(l) > 40 THEN left(l, 39) || '…' ELSE l END), chr(10)) AS text FROM documents""")
def elide(t):
    return t.docs().select("doc_id", X.elide(col("text"), 40).alias("text"))


@query("g20_visible_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def visible_length(t):
    # Every word is coloured; the visible text stays the same.
    styled = F.replace("text", F.lit(" "), F.lit(" \x1b[38;5;12m\x1b[1m"))
    return t.docs().select(
        "doc_id", X.visible_length(F.concat(styled, F.lit("\x1b[0m"))).alias("n"))
