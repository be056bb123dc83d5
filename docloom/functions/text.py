"""Docstring text as Column functions.

A document is one row, so its lines are handled as an array inside that row:
no explode, no shuffle, and a very long text costs one task no more than its own
length. Every function is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrays import let

# The whitespace characters a docstring may contain, as a Java class body.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# The same characters one by one, for trimming the ends of a text.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Tags whose first word is an argument.
ARG_TAGS = ("cvar", "ivar", "param", "raise", "raises", "type", "var")

# Tags that have a meaning beyond being stored.
KNOWN_TAGS = ("cvar", "param", "raise", "return", "rtype", "signature", "type")

# Fixed value: longest run between the end characters of inline emphasis.
SPAN_LIMIT = 128

TAG_START = rf"^[{SPACE}]*@[^{SPACE}]"


# -- single lines ---------------------------------------------------------


def indent(line: Column) -> Column:
    """Number of leading spaces; tabs do not count."""
    return F.length(line) - F.length(F.ltrim(line))


def is_blank(line: Column) -> Column:
    return ~line.rlike(rf"[^{SPACE}]")


def block_indent(line: Column) -> Column:
    """Leading spaces, NULL for a line of spaces only."""
    return F.when(F.trim(line) != "", indent(line))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def cut(line: Column, n: Column) -> Column:
    """The line without its first n characters."""
    return F.substr(line, n + 1)


def expand_tabs(line: Column) -> Column:
    """Tabs to spaces, stops every 8 columns."""
    def pad(piece):
        # Every tab ends on a multiple of 8, so each piece starts on one too.
        column = F.length(F.regexp_extract(piece, r"[^\r\n]*\z", 0))
        return F.concat(piece, F.repeat(F.lit(" "), F.lit(8) - column % 8))

    def expand(pieces):
        last = F.size(pieces) - 1
        return F.array_join(
            F.transform(pieces, lambda p, i: F.when(i < last, pad(p)).otherwise(p)), ""
        )

    return F.when(line.contains("\t"), let(F.split(line, "\t"), expand)).otherwise(line)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def inline_markup(text: Column) -> Column:
    """Backticks, underscores and asterisks to code, i and b elements, in that order."""
    inner = rf"([^{SPACE}][^\n]{{0,{SPAN_LIMIT}}}[^{SPACE}])"
    steps = (
        ("`", ((r"``([^\n]+?)``", "<code>$1</code>"), (r"`([^\n]+?)`", "<code>$1</code>"))),
        ("_", ((rf"([{SPACE}])_{inner}_([{SPACE}])", "$1<i>$2</i>$3"),)),
        ("*", (
            (rf"([{SPACE}])\*\*{inner}\*\*([{SPACE}])", "$1<b>$2</b>$3"),
            (rf"([{SPACE}])\*{inner}\*([{SPACE}])", "$1<i>$2</i>$3"),
        )),
    )

    def applied(text, char, patterns):
        # Most texts hold no such character; the patterns run on those that do.
        def change(t):
            changed = t
            for pattern, element in patterns:
                changed = F.regexp_replace(changed, pattern, element)
            return F.when(t.contains(char), changed).otherwise(t)

        return let(text, change)

    for char, patterns in steps:
        text = applied(text, char, patterns)
    return text


def bullet(line: Column) -> Column:
    """struct(bullet, text) of a line; bullet is NULL when there is none."""
    inner = F.ltrim(line)
    found = inner.startswith("-") | inner.startswith("*")
    lead = F.repeat(F.lit(" "), indent(line))
    return F.struct(
        F.when(found, F.substr(inner, F.lit(1), F.lit(1))).alias("bullet"),
        F.when(found, F.concat(lead, F.ltrim(F.substr(inner, F.lit(2))))).otherwise(line)
        .alias("text"),
    )


def visible_length(text: Column) -> Column:
    """Length without terminal control sequences."""
    return F.length(F.regexp_replace(text, r"\x1b\[[^@-~]*[^\n]", "")).cast("bigint")


def elide(text: Column, width: int) -> Column:
    """Cut each line that is too long and mark the cut."""
    def one(line):
        fits = visible_length(line) <= width
        return F.when(fits, line).otherwise(
            F.concat(F.substr(line, F.lit(1), F.lit(width - 1)), F.lit("…"))
        )

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


# -- lines of a text ------------------------------------------------------


def newline_lines(text: Column) -> Column:
    return F.split(text, "\n")


def normal_lines(text: Column) -> Column:
    """Lines with tabs expanded and the right end stripped."""
    return F.transform(F.split(text, "\n"), lambda l: rstrip(expand_tabs(l)))


def universal_lines(text: Column) -> Column:
    """Lines split at every Unicode line boundary; no empty line after a final break."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    def unended(pieces):
        last = F.size(pieces) - 1
        return F.when(F.get(pieces, last) == "", F.slice(pieces, F.lit(1), last)).otherwise(pieces)

    return let(F.split(text, breaks), unended)


def common_indent(lines: Column) -> Column:
    """Least indent over the non-blank lines, 0 when there are none."""
    indents = F.transform(F.filter(lines, lambda l: ~is_blank(l)), indent)
    return F.coalesce(F.array_min(indents), F.lit(0))


def cut_indent(lines: Column, ignore_first: bool = False) -> Column:
    """struct(indent, lines): the common indent and the lines without it.

    With `ignore_first`, line one is left out of the minimum and loses at most
    its own indent; a one-line text is treated as usual.
    """
    def plain(ls):
        return let(common_indent(ls), lambda n: F.struct(
            n.alias("indent"), F.transform(ls, lambda l: cut(l, n)).alias("lines")))

    def skip_first(ls):
        return let(common_indent(F.slice(ls, F.lit(2), F.size(ls))), lambda n: F.struct(
            n.alias("indent"),
            F.transform(ls, lambda l, i: cut(
                l, F.when(i == 0, F.least(n, indent(l))).otherwise(n))).alias("lines")))

    if not ignore_first:
        return let(lines, plain)
    return let(lines, lambda ls: F.when(F.size(ls) > 1, skip_first(ls)).otherwise(plain(ls)))


def remove_indent(lines: Column) -> Column:
    """Lines without the common indent, blank lines untouched; NULL if all are blank."""
    def body(ls):
        return let(common_indent(ls), lambda n: F.transform(
            ls, lambda l: F.when(is_blank(l), l).otherwise(cut(l, n))))

    return let(lines, lambda ls: F.when(F.exists(ls, lambda l: ~is_blank(l)), body(ls)))


def paragraphs(lines: Column) -> Column:
    """Maximal runs of non-blank lines, each joined by newlines."""
    text = F.array_join(
        F.transform(lines, lambda l: F.when(is_blank(l), F.lit("")).otherwise(l)), "\n"
    )
    return F.filter(
        F.split(F.btrim(text, F.lit("\n")), "\n\n+"), lambda p: p != ""
    )


# -- runs -----------------------------------------------------------------


def runs(lines: Column, is_start) -> Column:
    """Cut lines into runs: array of struct(head, at, rest), one per starting line.

    `is_start(line)` marks starts; `rest` holds the lines up to the next start.
    Lines before the first start are in no run.
    """
    def cut_at(ls):
        starts = F.filter(
            F.transform(ls, lambda l, i: F.when(is_start(l), i)), lambda i: i.isNotNull()
        )
        return let(starts, lambda st: F.transform(st, lambda s, k: F.struct(
            F.get(ls, s).alias("head"),
            s.cast("bigint").alias("at"),
            F.slice(
                ls, s + 2, F.coalesce(F.get(st, k + 1), F.size(ls)) - s - 1
            ).alias("rest"),
        )))

    return let(lines, cut_at)


def lead_lines(lines: Column, is_start) -> Column:
    """The lines before the first starting line."""
    def before(ls):
        marks = F.transform(ls, is_start)
        at = F.array_position(marks, F.lit(True)).cast("int")
        return F.when(at == 0, ls).otherwise(F.slice(ls, F.lit(1), at - 1))

    return let(lines, before)


# -- tags -----------------------------------------------------------------


def is_tag_line(line: Column) -> Column:
    lead = F.ltrim(line, F.lit(SPACE_CHARS))
    return lead.startswith("@") & line.rlike(TAG_START)


def split_tags(lines: Column) -> Column:
    """struct(doc_lines, tags): documentation lines, and tags as (tag, arg, text).

    A tag line opens a tag. Later lines at its indent or deeper belong to the
    latest tag; the others are documentation and do not close it.
    """
    def one_tag(run):
        # The head without its white space is `@tag`, then the rest.
        return let(strip(run["head"]), lambda h: let(
            F.regexp_extract(h, rf"^@([^{SPACE}]+)", 1), lambda tag: let(
                strip(cut(h, F.length(tag) + 1)), lambda rest: filled(run, tag, rest))))

    def filled(run, tag, rest):
        takes_arg = tag.isin(*ARG_TAGS) & (rest != "")
        first = F.when(takes_arg, F.regexp_extract(rest, rf"^([^{SPACE}]+)", 1))
        return let(first, lambda arg: F.struct(
            tag.alias("tag"), arg.alias("arg"),
            inline_markup(let(
                F.when(arg.isNull(), rest).otherwise(strip(cut(rest, F.length(arg)))),
                lambda opening: joined(run, opening))).alias("text"),
        ))

    def joined(run, opening):
        more = let(indent(run["head"]), lambda depth: F.transform(
            F.filter(run["rest"], lambda l: indent(l) >= depth), strip))
        return F.array_join(F.when(
            opening != "", F.concat(F.array(opening), more)).otherwise(more), "\n")

    def outside(run):
        return let(indent(run["head"]), lambda depth: F.filter(
            run["rest"], lambda l: indent(l) < depth))

    def split(ls):
        return let(runs(ls, is_tag_line), lambda rs: F.struct(
            F.concat(
                lead_lines(ls, is_tag_line), F.flatten(F.transform(rs, outside))
            ).alias("doc_lines"),
            F.transform(rs, one_tag).alias("tags"),
        ))

    return let(lines, split)


# -- documents ------------------------------------------------------------


def normalise_doc(text: Column) -> Column:
    """struct(doc_lines, tags) of a docstring: indentation removed, then tags split off."""
    return split_tags(cut_indent(universal_lines(text), ignore_first=True)["lines"])


def one_line(paragraph: Column, strip_left: bool = True) -> Column:
    """A paragraph's lines joined by spaces."""
    pattern = rf"(^|\n)[{SPACE}&&[^\n]]+" if strip_left else r"(^|\n)"
    text = F.regexp_replace(paragraph, pattern, "$1")
    return F.replace(text, F.lit("\n"), F.lit(" "))


def summary(doc_lines: Column) -> Column:
    """First paragraph on one line, escaped and marked up; NULL without text."""
    return inline_markup(escape_html(one_line(F.get(paragraphs(doc_lines), F.lit(0)))))


# What a first block that is not a plain paragraph looks like.
NOT_PROSE = r"^( {4}|\t|#{1,6}[^#\n]|```|>>> | {0,3}[-*+] | {0,3}[0-9]+\. )|^[^\n]+\n(=+|-+) *(\n|\z)"


def prose_summary(doc_lines: Column) -> Column:
    """As `summary`, but NULL when the text opens with a heading, list, code or doctest."""
    first = F.get(paragraphs(doc_lines), F.lit(0))
    return F.when(~first.rlike(NOT_PROSE), inline_markup(escape_html(one_line(first))))


def body_text(doc_lines: Column) -> Column:
    """Everything after the first paragraph, paragraphs kept apart by one blank line."""
    pars = paragraphs(doc_lines)
    return let(pars, lambda ps: F.array_join(F.slice(ps, F.lit(2), F.size(ps)), "\n\n"))


def parse_doc(text: Column) -> Column:
    """struct(doc, summary, body, tags) of a docstring."""
    def build(d):
        return F.struct(
            F.array_join(d["doc_lines"], "\n").alias("doc"),
            prose_summary(d["doc_lines"]).alias("summary"),
            body_text(d["doc_lines"]).alias("body"),
            d["tags"].alias("tags"),
        )

    return F.when(text.isNotNull(), let(normalise_doc(text), build))


# -- labelled folds -------------------------------------------------------
#
# Some segmentations depend on state carried from line to line. The fold keeps a
# few scalars and one label character per line; segments are then cut from the
# label string. A string that grows by one character is copied for every line, so
# lines are folded in blocks: a block's labels are a short string, the state passes to
# the next block, and the strings of the blocks are joined once.

# Lines folded into one label string.
BLOCK = 512


def _labels(lines: Column, state: dict, step) -> Column:
    """Fold `step(acc, line) -> (state updates, label)` over lines to a label string."""
    def merge(acc, line):
        new, label = step(acc, line)
        return F.struct(
            *[new.get(k, acc[k]).alias(k) for k in state],
            F.concat(acc["labels"], label).alias("labels"),
        )

    def fold(ls):
        starts = F.when(F.size(ls) > 0, F.sequence(F.lit(1), F.size(ls), F.lit(BLOCK))).when(
            F.size(ls) == 0, F.array().cast("array<int>"))
        zero = F.struct(
            *[v.alias(k) for k, v in state.items()],
            F.array().cast("array<string>").alias("done"),
        )

        def block(acc, start):
            entered = F.struct(*[acc[k].alias(k) for k in state], F.lit("").alias("labels"))
            left = F.aggregate(F.slice(ls, start, F.lit(BLOCK)), entered, merge)
            return let(left, lambda end: F.struct(
                *[end[k].alias(k) for k in state],
                F.concat(acc["done"], F.array(end["labels"])).alias("done"),
            ))

        return F.aggregate(starts, zero, block, lambda acc: F.array_join(acc["done"], ""))

    return let(lines, fold)


def label_array(labels: Column) -> Column:
    return F.filter(F.split(labels, ""), lambda c: c != "")


def labelled(lines: Column, labels: Column) -> Column:
    """Array of struct(label, line)."""
    return F.zip_with(
        label_array(labels), lines, lambda c, l: F.struct(c.alias("label"), l.alias("line"))
    )


def _pick(run, wanted: str):
    """Lines of a labelled run that carry one of the `wanted` labels."""
    every = F.concat(F.array(run["head"]), run["rest"])
    return F.transform(F.filter(every, lambda x: x["label"].isin(*wanted)), lambda x: x["line"])


# -- doctests -------------------------------------------------------------


def doctest_labels(lines: Column) -> Column:
    """One label a line: S prompt, C continuation, O output, - text."""
    def step(acc, line):
        depth = indent(line)
        prompt = F.ltrim(line).startswith(">>> ")
        at_depth = depth >= acc["indent"]
        tail = cut(line, acc["indent"])
        more = (acc["mode"] == 1) & at_depth & tail.startswith("... ")
        out = (acc["mode"] > 0) & at_depth & ~is_blank(line) & ~tail.startswith(">>>")
        label = (
            F.when(more, F.lit("C")).when(out, F.lit("O")).when(prompt, F.lit("S"))
            .otherwise(F.lit("-"))
        )
        opens = ~more & ~out & prompt
        return {
            "indent": F.when(opens, depth).otherwise(acc["indent"]),
            "mode": F.when(more, F.lit(1)).when(out, F.lit(2)).when(prompt, F.lit(1))
            .otherwise(F.lit(0)),
        }, label

    return _labels(lines, {"indent": F.lit(0), "mode": F.lit(0)}, step)


def doctests(lines: Column) -> Column:
    """Array of struct(at, source, output): examples without their prompts."""
    def examples(ls):
        def example(run):
            depth = indent(run["head"]["line"])
            return F.struct(
                run["at"].alias("at"),
                F.array_join(
                    F.transform(_pick(run, "SC"), lambda l: cut(l, depth + 4)), "\n"
                ).alias("source"),
                F.array_join(
                    F.transform(_pick(run, "O"), lambda l: cut(l, depth)), "\n"
                ).alias("output"),
            )

        marked = labelled(ls, doctest_labels(ls))
        return F.transform(runs(marked, lambda x: x["label"] == "S"), example)

    return F.when(
        F.exists(lines, lambda l: l.contains(">>> ")), let(lines, examples)
    ).otherwise(F.array().cast("array<struct<at:bigint,source:string,output:string>>"))


# -- body blocks ----------------------------------------------------------


def body_blocks(lines: Column) -> Column:
    """Blocks after the summary paragraph: array of struct(kind, text).

    A paragraph starting `>>>` is a doctest. After a text paragraph whose last
    line ends with a colon, deeper paragraphs form one code block, with an empty
    line after each; the first paragraph that is not deeper is handled as usual.
    """
    def shaped(par):
        return let(cut_indent(F.split(par, "\n")), lambda c: F.struct(
            c["indent"].alias("indent"),
            F.array_join(c["lines"], "\n").alias("text"),
        ))

    def step(acc, p):
        code = acc["inside"] & (p["indent"] > acc["base"])
        test = p["text"].startswith(">>>")
        colon = rstrip(p["text"]).endswith(":")
        label = F.when(code, F.lit("c")).when(test, F.lit("d")).otherwise(F.lit("p"))
        return {
            "base": F.when(code, acc["base"]).otherwise(p["indent"]),
            "inside": code | (~test & colon),
        }, label

    def cut_blocks(ps):
        labels = label_array(
            _labels(ps, {"base": F.lit(0), "inside": F.lit(False)}, step))

        def build(ls):
            marked = F.transform(ps, lambda p, i: F.struct(
                F.get(ls, i).alias("label"),
                p["text"].alias("line"),
                ((F.get(ls, i) != "c") | (F.get(ls, i - 1) != "c")).alias("opens"),
            ))
            return F.transform(runs(marked, lambda x: x["opens"]), block)

        return let(labels, build)

    def block(run):
        label, text = run["head"]["label"], run["head"]["line"]
        code = F.array_join(
            F.transform(_pick(run, "c"), lambda t: F.concat(t, F.lit("\n"))), "\n")
        return F.struct(
            F.when(label == "c", F.lit("code")).when(label == "d", F.lit("doctest"))
            .otherwise(F.lit("text")).alias("kind"),
            F.when(label == "c", escape_html(code)).when(label == "d", text)
            .otherwise(inline_markup(escape_html(F.replace(text, F.lit("\n"), F.lit(" ")))))
            .alias("text"),
        )

    def rest(ps):
        return let(F.transform(F.slice(ps, F.lit(2), F.size(ps)), shaped), cut_blocks)

    return let(paragraphs(lines), rest)


# -- bullet lists ---------------------------------------------------------


def bullet_labels(lines: Column) -> Column:
    """One label a line: L opens a list, I opens an item, C continues one, - is outside."""
    def step(acc, line):
        b, depth = bullet(line)["bullet"], block_indent(line)
        ends = acc["open"] & (
            F.coalesce(depth < acc["indent"], F.lit(False))
            | F.coalesce(b != acc["bullet"], F.lit(False))
            | (acc["blank"] & b.isNull() & F.coalesce(depth == acc["indent"], F.lit(False)))
        )
        still = acc["open"] & ~ends
        opens = b.isNotNull() & ~still
        item = b.isNotNull() & still & F.coalesce(depth == acc["indent"], F.lit(False))
        label = (
            F.when(opens, F.lit("L")).when(item, F.lit("I")).when(still, F.lit("C"))
            .otherwise(F.lit("-"))
        )
        return {
            "open": still | opens,
            "indent": F.when(opens, depth).otherwise(acc["indent"]),
            "bullet": F.when(opens, b).otherwise(acc["bullet"]),
            "blank": F.trim(line) == "",
        }, label

    return _labels(
        lines,
        {"open": F.lit(False), "indent": F.lit(0), "bullet": F.lit(""), "blank": F.lit(False)},
        step,
    )


def bullet_lists(lines: Column) -> Column:
    """Array of lists, each an array of struct(at, text) items; nested bullets stay inside."""
    def item(run):
        first = bullet(run["head"]["line"])["text"]
        return F.struct(
            run["at"].alias("at"),
            F.array_join(F.concat(
                F.array(first), F.transform(run["rest"], lambda x: x["line"])), "\n"
            ).alias("text"),
        )

    def in_list(run):
        # A list ends at the first line outside it.
        every = F.concat(F.array(run["head"]), run["rest"])
        inside = lead_lines(every, lambda x: x["label"] == "-")
        return F.transform(
            runs(inside, lambda x: x["label"].isin("L", "I")),
            lambda r: F.struct((r["at"] + run["at"]).alias("at"), item(r)["text"].alias("text")),
        )

    def build(ls):
        marked = labelled(ls, bullet_labels(ls))
        return F.transform(runs(marked, lambda x: x["label"] == "L"), in_list)

    return let(lines, build)


# -- indentation blocks ---------------------------------------------------


def _text_base(lines: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(lines, block_indent)), F.lit(0))


def indent_groups(lines: Column) -> Column:
    """Base-level lines one by one, deeper (or blank) runs together: struct(kind, at, text)."""
    def build(ls):
        def with_base(n):
            base = F.transform(
                ls, lambda l: F.coalesce(block_indent(l) == n, F.lit(False)))
            return let(base, lambda flags: F.transform(
                runs(
                    F.transform(ls, lambda l, i: F.struct(
                        F.get(flags, i).alias("base"), l.alias("line"),
                        (F.get(flags, i) | F.coalesce(F.get(flags, i - 1), F.lit(True)))
                        .alias("opens"))),
                    lambda x: x["opens"],
                ),
                lambda r: F.struct(
                    F.when(r["head"]["base"], F.lit("LINE")).otherwise(F.lit("DIV")).alias("kind"),
                    r["at"].alias("at"),
                    F.array_join(F.transform(
                        F.concat(F.array(r["head"]), r["rest"]), lambda x: x["line"]), "\n"
                    ).alias("text"),
                ),
            ))

        return let(_text_base(ls), with_base)

    return let(lines, build)


def block_labels(lines: Column, base: Column) -> Column:
    """One label a line: P or D opens a base or deeper block, p or d continues, - is dropped."""
    def step(acc, line):
        depth = block_indent(line)
        blank = depth.isNull()
        at_base = F.coalesce(depth == base, F.lit(False))
        label = (
            F.when(blank & (acc["kind"] == "d"), F.lit("d"))
            .when(blank, F.lit("-"))
            .when(at_base & (acc["kind"] == "p"), F.lit("p"))
            .when(at_base, F.lit("P"))
            .when(acc["kind"] == "d", F.lit("d"))
            .otherwise(F.lit("D"))
        )
        return {"kind": F.lower(label)}, label

    return _labels(lines, {"kind": F.lit("-")}, step)


def blocks(lines: Column) -> Column:
    """Blocks of a text: array of struct(kind, at, text), kind P, DIV or DOCTEST."""
    def block(run):
        text = F.array_join(_pick(run, "PpDd"), "\n")
        base = run["head"]["label"] == "P"
        return F.struct(
            F.when(text.startswith(">>> "), F.lit("DOCTEST")).when(base, F.lit("P"))
            .otherwise(F.lit("DIV")).alias("kind"),
            run["at"].alias("at"),
            text.alias("text"),
        )

    def build(ls):
        return let(labelled(ls, let(_text_base(ls), lambda n: block_labels(ls, n))), lambda m:
            F.transform(runs(m, lambda x: x["label"].isin("P", "D")), block))

    return let(lines, build)
