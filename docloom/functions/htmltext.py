"""HTML pages to plain text, and page audits, as Column functions.

One page is one row; every step is a regular expression or an array function over
it, so there is no shuffle. Bad nesting is tolerated.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrays import let
from docloom.functions.text import SPACE

# Elements with a style of their own.
BLOCK_TAGS = ("div", "h1", "h2", "h3", "li", "ol", "p", "pre", "ul")
INLINE_TAGS = ("a", "b", "code", "em", "i", "span", "strong", "u")
SPAN_CLASSES = ("cp", "k", "mi", "n", "nb", "o", "ow", "p", "prompt", "s1", "s2")
DIV_CLASSES = ("codehilite", "doctest", "src", "out")

# Text put before the first word of an element.
PREFIXES = {"h1": "✪ ", "h2": "★ ", "h3": "✴ ", "li": "∙ "}
PRE_MARK = "┃ "
LIST_INDENT = "  "

# Elements that never have an end tag.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)

# What may stand between a tag's name and its end; quoted values may hold `>`.
ATTRS = r"""\b(?:[^>"']++|"[^"]*"|'[^']*')*+"""
ANY_TAG = rf"</?[a-zA-Z][a-zA-Z0-9]*{ATTRS}>|<[!?][^>]*>"

# Marks inside the text while it is being laid out.
BREAK, SPARE_OPEN, SPARE_CLOSE, DEEPER, SHALLOWER = "\x01", "\x02", "\x03", "\x04", "\x05"
PRE_NEWLINE, PRE_SPACE, PRE_TAB = "\x06", "\x07", "\x08"
TAG_OPEN, TAG_CLOSE = "\x0e", "\x0f"
GUARDED_PRE_MARK = PRE_MARK.replace(" ", PRE_SPACE)
MARKS = r"[\x01-\x05]"


# Stands in a start tag that no end tag follows, while elements are sought.
_OPEN = "\ufdd0"


def strip_hidden(html: Column) -> Column:
    """Without comments, scripts and style sheets, in time proportional to the page.

    A start without an end behind it would be followed to the end of the page in vain. So
    comments are sought up to the last `-->` only, and start tags behind the last end tag of
    their kind are marked before: every other one is closed somewhere, and what is between is
    read once.
    """
    def upto(text, last, change, rest):
        head = F.regexp_extract(text, rf"(?is)^.*{last}", 0)
        return let(head, lambda h: F.concat(change(h), rest(F.substr(text, F.length(h) + 1))))

    def marked(kind):
        return lambda text: upto(text, rf"</{kind}\s*>", lambda h: h,
                                 lambda t: F.regexp_replace(t, rf"(?i)<({kind})\b", f"<{_OPEN}$1"))

    text = let(html, lambda h: upto(h, "-->", lambda t: F.regexp_replace(t, r"(?s)<!--.*?-->", ""), lambda t: t))
    for kind in ("script", "style"):
        text = let(text, marked(kind))
    text = F.regexp_replace(text, rf"(?is)<(script|style){ATTRS}>.*?</\1\s*>", "")
    return F.replace(text, F.lit(f"<{_OPEN}"), F.lit("<"))


def _entity_tables() -> dict[str, dict[str, str]]:
    """Named character references that end in a semicolon, by first letter."""
    tables: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        if name.endswith(";"):
            tables.setdefault(name[0], {})[name[:-1]] = chars
    return tables


def _western() -> dict[str, str]:
    """Characters of the codes 128 to 159 in Windows-1252, where it defines them."""
    codes = range(128, 160)
    chars = {c: bytes([c]).decode("cp1252", errors="ignore") for c in codes}
    return {str(c): chars[c] or chr(c) for c in codes}


def _bare_names() -> list[str]:
    """Names that also work without the semicolon, longest first."""
    return sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _literal_map(table: dict[str, str]) -> Column:
    # A constant, so the optimizer parses it once per plan.
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to characters."""
    tables = _entity_tables()
    bare = "|".join(_bare_names())

    def named(name):
        chosen = None
        for letter, table in tables.items():
            value = F.try_element_at(_literal_map(table), name)
            hit = name.startswith(letter)
            chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
        return chosen

    def numeric(digits, base):
        # Leading zeros mean nothing; more than 8 digits are beyond every character.
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        digits = F.when(F.length(digits) > 8, F.lit("0")).otherwise(digits)
        code = F.conv(digits, base, 10).cast("bigint")
        fits = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        control = code.between(1, 8) | code.between(11, 11) | code.between(14, 31) | (code == 127)
        char = F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")
        # Browsers read this range as Windows-1252.
        western = F.try_element_at(_literal_map(_western()), code.cast("string"))
        return (
            F.when(code.between(128, 159), F.coalesce(western, F.lit("")))
            .when(fits & control, "").when(fits, char).otherwise("\ufffd")
        )

    def piece(p):
        name = F.regexp_extract(p, r"^([a-zA-Z][a-zA-Z0-9]*);", 1)
        dec = F.regexp_extract(p, r"^#([0-9]+);?", 1)
        hexa = F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]+);?", 1)
        short = F.regexp_extract(p, rf"^({bare})", 1)
        after = F.regexp_replace(p, r"^[^;]*;", "")
        known = named(name)
        kept = F.concat(F.lit("&"), p)
        return (
            F.when((name != "") & known.isNotNull(), F.concat(known, after))
            .when(dec != "", F.concat(
                numeric(dec, 10), F.regexp_replace(p, r"^#[0-9]+;?", "")))
            .when(hexa != "", F.concat(
                numeric(hexa, 16), F.regexp_replace(p, r"^#[xX][0-9a-fA-F]+;?", "")))
            .when(short != "", F.concat(
                named(short), F.substr(p, F.length(short) + 1)))
            .otherwise(kept)
        )

    # Common names first, by plain replacement; a bare ampersand has to come last.
    quick = text
    for name in ("nbsp", "lt", "gt", "quot", "copy", "middot"):
        quick = F.replace(quick, F.lit(f"&{name};"), F.lit(html5[f"{name};"]))

    def others(t):
        pieces = F.split(t, "&")
        return F.array_join(
            F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")

    def finish(t):
        rare = t.rlike(r"&(?!amp;)(#|[a-zA-Z])")
        return F.when(rare, others(t)).otherwise(F.replace(t, F.lit("&amp;"), F.lit("&")))

    return let(quick, finish)


def _mark_tags(html: Column) -> Column:
    """Block tags to marks, other tags removed."""
    # One pass drops attributes and all other tags; the later passes see short tags only.
    names = "|".join(BLOCK_TAGS)
    text = F.regexp_replace(
        html, rf"(?i)<(/?)({names}){ATTRS}>|{ANY_TAG}", f"{TAG_OPEN}$1$2{TAG_CLOSE}")
    text = F.replace(text, F.lit(TAG_OPEN + TAG_CLOSE), F.lit(""))

    marks = {}
    for name in BLOCK_TAGS:
        spare = SPARE_OPEN if name in ("h1", "h2") else ""
        turn = DEEPER if name in ("ol", "ul") else ""
        lead = GUARDED_PRE_MARK if name == "pre" else PREFIXES.get(name, "")
        marks[name] = BREAK + spare + turn + lead
        spare = SPARE_CLOSE if name in ("div", "p") else ""
        turn = SHALLOWER if name in ("ol", "ul") else ""
        marks[f"/{name}"] = BREAK + spare + turn

    # Plain replacement for the usual spelling, patterns for what is left.
    for name, mark in marks.items():
        text = F.replace(text, F.lit(TAG_OPEN + name + TAG_CLOSE), F.lit(mark))

    def odd_case(t):
        for name, mark in marks.items():
            t = F.regexp_replace(t, rf"(?i){TAG_OPEN}{name}{TAG_CLOSE}", mark)
        return t

    return _where(text, lambda t: t.contains(TAG_OPEN), odd_case)


def _guard_pre(html: Column) -> Column:
    """White space inside pre elements to marks, so that it survives."""
    def guard(part):
        inside = F.translate(part, "\n \t", PRE_NEWLINE + PRE_SPACE + PRE_TAB)
        opened = F.regexp_extract(part, rf"(?i)^<pre{ATTRS}>", 0)
        body = F.substr(inside, F.length(opened) + 1)
        return F.when(opened != "", F.concat(opened, body)).otherwise(part)

    def guarded(text):
        parts = F.split(text, r"(?i)(?=<pre\b)|(?<=</pre>)")
        return F.array_join(F.transform(parts, guard), "")

    return _where(html, lambda h: h.rlike(r"(?i)<pre\b"), guarded)


def _where(text: Column, wanted, change) -> Column:
    """`change(text)` where `wanted(text)`, computing the text once."""
    return let(text, lambda t: F.when(wanted(t), change(t)).otherwise(t))


def _lay_out(text: Column) -> Column:
    """Runs of marks between words to line breaks.

    A run gives one break, one more for every spare close in it and one more if it
    has a spare open; at the start of the text one less. The line break that ends a
    pre element counts as the break of its end tag.
    """
    text = F.regexp_replace(text, rf" *({MARKS}) *", "$1")
    text = F.regexp_replace(text, r"^ +|\x06(?=\x01)", "")
    text = F.regexp_replace(text, r"\x02(?=[\x01\x03-\x05]*\x02)", "")
    text = F.regexp_replace(text, rf"(?<={MARKS})\x01|^\x01", "")
    for mark in (BREAK, SPARE_OPEN, SPARE_CLOSE):
        text = F.replace(text, F.lit(mark), F.lit("\n"))
    return F.replace(text, F.lit(PRE_NEWLINE), F.lit("\n" + GUARDED_PRE_MARK))


def _indent_lists(text: Column) -> Column:
    """Indent lines by the list depth at their start."""
    def delta(segment):
        marks = F.regexp_extract(segment, r"^[\x04\x05]*", 0)
        opens = F.length(F.translate(marks, SHALLOWER, ""))
        return opens * 2 - F.length(marks)

    def depths(segments):
        zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("all"))

        def step(acc, segment):
            depth = F.greatest(F.lit(0), acc["depth"] + delta(segment)).cast("int")
            return F.struct(depth.alias("depth"), F.concat(acc["all"], F.array(depth)).alias("all"))

        return F.aggregate(segments, zero, step, lambda acc: acc["all"])

    def indented(text):
        segments = F.split(text, r"\n(?=[\x04\x05])")
        return let(segments, lambda segs: let(depths(segs), lambda d: F.array_join(F.transform(
            segs, lambda s, i: F.regexp_replace(
                F.regexp_replace(s, r"^[\x04\x05]*", ""), F.lit(r"(?md)^(?=[^\n])"),
                F.repeat(F.lit(LIST_INDENT), F.get(d, i)),
            )), "\n")))

    return _where(text, lambda t: t.rlike(r"[\x04\x05]"), indented)


def to_text(html: Column) -> Column:
    """Plain text of an HTML page or fragment."""
    clean = F.regexp_replace(html, r"[\x01-\x08\x0e\x0f]", "")
    marked = _mark_tags(_guard_pre(strip_hidden(clean)))
    text = F.regexp_replace(decode_entities(marked), rf"[{SPACE}&&[^\x1c-\x1f]]+", " ")
    text = _indent_lists(_lay_out(text))
    text = F.replace(F.replace(text, F.lit(PRE_SPACE), F.lit(" ")), F.lit(PRE_TAB), F.lit("\t"))
    return F.regexp_replace(text, r"[\n ]+\z", "")


# -- audits ---------------------------------------------------------------


def tag_names(html: Column) -> Column:
    """Names of all start tags, in order, lower case."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1), F.lower)


def unknown_marks(html: Column) -> Column:
    """Array of struct(kind, name): tags and div or span classes without a style."""
    hidden = strip_hidden(html)
    tags = F.filter(tag_names(hidden), lambda n: ~n.isin(*BLOCK_TAGS, *INLINE_TAGS))

    def classes(tag, known):
        opened = F.regexp_extract_all(hidden, F.lit(rf"(?i)<{tag}({ATTRS})>"), 1)
        named = F.transform(opened, lambda a: F.regexp_extract(
            a, r"""(?i)\bclass\s*=\s*["']?([^"'>]*)""", 1))
        return F.filter(named, lambda c: ~c.isin(*known))

    def marked(kind, names):
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    # A span without a class has a style, a div without one does not.
    return F.concat(
        marked("tag", tags),
        marked("span class", classes("span", (*SPAN_CLASSES, ""))),
        marked("div class", classes("div", DIV_CLASSES)),
    )


def tag_events(html: Column) -> Column:
    """Array of struct(tag, step): +1 for a start tag, -1 for an end tag, void tags left out."""
    found = F.regexp_extract_all(strip_hidden(html), F.lit(rf"(</?[a-zA-Z][a-zA-Z0-9]*){ATTRS}>"), 1)
    events = F.transform(found, lambda f: F.struct(
        F.lower(F.regexp_replace(f, "^</?", "")).alias("tag"),
        F.when(f.startswith("</"), -1).otherwise(1).alias("step")))
    return F.filter(events, lambda e: ~e["tag"].isin(*VOID_TAGS))
