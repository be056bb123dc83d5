"""Documentation tags meeting signatures, as joins keyed by (object, name).

Keys carry the parameter or member name, so even one object that holds a large
share of all tags is spread over tasks; last-wins choices are aggregates that
combine before the shuffle.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.generate import explode_rows

col = F.col


def tag_values(tags: DataFrame) -> DataFrame:
    """Last `@param` and `@type` text per object and parameter name: obj, name, doc, doc_type."""
    return tags.filter(col("tag").isin("param", "type")).groupBy(
        "obj", col("arg").alias("name")
    ).agg(
        F.max_by("text", F.when(col("tag") == "param", col("pos"))).alias("doc"),
        F.max_by("text", F.when(col("tag") == "type", col("pos"))).alias("doc_type"),
    )


def attach_to_params(params: DataFrame, tags: DataFrame) -> DataFrame:
    """Parameters with the doc and doc_type of their last matching tags."""
    return params.join(tag_values(tags), ["obj", "name"], "left")


def unmatched_tags(params: DataFrame, tags: DataFrame) -> DataFrame:
    """`@param` and `@type` tags that name no parameter of their object."""
    named = params.select("obj", col("name").alias("arg"))
    return tags.filter(col("tag").isin("param", "type")).join(named, ["obj", "arg"], "left_anti")


def attach_returns(tags: DataFrame) -> DataFrame:
    """Return doc and doc_type per object, the last of each tag."""
    return tags.filter(col("tag").isin("return", "rtype")).groupBy("obj").agg(
        F.max_by("text", F.when(col("tag") == "return", col("pos"))).alias("doc"),
        F.max_by("text", F.when(col("tag") == "rtype", col("pos"))).alias("doc_type"),
    )


def exceptions(tags: DataFrame) -> DataFrame:
    """Documented exceptions in tag order, one row each: obj, pos, exc_type, doc."""
    return tags.filter(col("tag") == "raise").select(
        "obj", "pos", col("arg").alias("exc_type"), col("text").alias("doc"))


def attach_to_members(members: DataFrame, tags: DataFrame) -> DataFrame:
    """Class members documented by `@cvar` tags of their class, the last tag per name."""
    docs = tags.filter(col("tag") == "cvar").groupBy("obj", col("arg").alias("member_name")).agg(
        F.max_by("text", "pos").alias("doc"))
    return members.join(docs, ["obj", "member_name"])


def signature_tags(objects: DataFrame, tags: DataFrame, params: DataFrame) -> DataFrame:
    """First `@signature` text of every callable that has no signature of its own."""
    bare = objects.filter("callable").join(
        params.select("obj").distinct(), "obj", "left_anti")
    first = tags.filter(col("tag") == "signature").groupBy("obj").agg(
        F.min_by("text", "pos").alias("text"))
    return bare.join(first, "obj")


PARAM = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("default_repr", T.StringType()),
    T.StructField("annotation", T.StringType()),
])
SIGNATURE = T.StructType([
    T.StructField("params", T.ArrayType(PARAM)),
    T.StructField("return_annotation", T.StringType()),
])


def source_of(node: ast.AST) -> str:
    """Source text of an expression; a marker where it is nested too deeply to be written out."""
    # The plain cases, which are most, without the visitor.
    names, at = [], node
    while isinstance(at, ast.Attribute):
        names.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        return ".".join([at.id, *names[::-1]])
    if isinstance(node, ast.Constant) and type(node.value) in (int, bool):
        return repr(node.value)
    try:
        return ast.unparse(node)
    except (RecursionError, MemoryError):
        return "..."


def param_rows(args: ast.arguments) -> list[dict]:
    """Parameters of a parsed argument list, in order, with source text of their parts."""
    positional = [(a, "POSITIONAL_ONLY") for a in args.posonlyargs]
    positional += [(a, "POSITIONAL_OR_KEYWORD") for a in args.args]
    defaults = [None] * (len(positional) - len(args.defaults)) + list(args.defaults)
    every = [(a, kind, d) for (a, kind), d in zip(positional, defaults)]
    if args.vararg:
        every.append((args.vararg, "VAR_POSITIONAL", None))
    every += [(a, "KEYWORD_ONLY", d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    if args.kwarg:
        every.append((args.kwarg, "VAR_KEYWORD", None))
    return [
        {
            "pos": i,
            "name": a.arg,
            "kind": kind,
            "default_repr": None if d is None else source_of(d),
            "annotation": None if a.annotation is None else source_of(a.annotation),
        }
        for i, (a, kind, d) in enumerate(every, 1)
    ]


@F.pandas_udf(SIGNATURE)
def parse_signature(text: pd.Series) -> pd.DataFrame:
    """Parse `name(params) -> annotation` texts; NULL fields where one does not parse.

    The text is only parsed, never run.
    """
    def one(signature):
        try:
            node = ast.parse(f"def {signature.strip()}: pass").body[0]
        except (SyntaxError, ValueError, AttributeError, RecursionError, MemoryError):
            return None, None
        if not isinstance(node, ast.FunctionDef):
            return None, None
        back = None if node.returns is None else source_of(node.returns)
        return param_rows(node.args), back

    parsed = [one(s) for s in text]
    return pd.DataFrame({
        "params": pd.Series([p for p, _ in parsed], dtype=object),
        "return_annotation": pd.Series([r for _, r in parsed], dtype=object),
    })


def parsed_params(signatures: DataFrame) -> DataFrame:
    """Parameter rows of signature texts (obj, text)."""
    parsed = signatures.select("obj", parse_signature("text").alias("s"))
    return explode_rows(parsed, ["obj"], col("s.params"), "p", pos="_at").select("obj", "p.*")


def effective_signature(own: Column, wrapped: Column) -> Column:
    return F.coalesce(own, wrapped)


def marked_name(name: Column, kind: Column) -> Column:
    stars = F.when(kind == "VAR_POSITIONAL", "*").when(kind == "VAR_KEYWORD", "**").otherwise("")
    return F.concat(stars, name)


def signature_text(params: Column) -> Column:
    """`(a, *, b)` from an array of struct(pos, name, kind) in order; `(⁇)` for NULL.

    A bare star goes before the first keyword-only parameter unless a star came first.
    """
    flat = F.array_join(F.transform(params, lambda p: marked_name(p["name"], p["kind"])), ", ")
    starred = F.filter(params, lambda p: p["kind"].isin("KEYWORD_ONLY", "VAR_POSITIONAL", "VAR_KEYWORD"))
    bare = F.get(starred, F.lit(0))["kind"] == "KEYWORD_ONLY"
    first = F.get(starred, F.lit(0))["pos"]
    lead = F.filter(params, lambda p: p["pos"] < first)
    rest = F.filter(params, lambda p: p["pos"] >= first)

    def names(part):
        return F.transform(part, lambda p: marked_name(p["name"], p["kind"]))

    with_star = F.array_join(F.concat(names(lead), F.array(F.lit("*")), names(rest)), ", ")
    shown = F.when(F.coalesce(bare, F.lit(False)), with_star).otherwise(flat)
    return F.concat(F.lit("("), F.coalesce(shown, F.lit("⁇")), F.lit(")"))


def signature_texts(params: DataFrame) -> DataFrame:
    """obj, signature for every object with parameter rows.

    The result holds a signature as one text, so its parameters meet in one row.
    """
    ordered = params.groupBy("obj").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "kind"))).alias("params"))
    return ordered.select("obj", signature_text(col("params")).alias("signature"))


# Bullet mark by parameter kind.
BULLET_BY_KIND = {
    "POSITIONAL_OR_KEYWORD": "right-circled",
    "POSITIONAL_ONLY": "cc-zero",
    "KEYWORD_ONLY": "cc-nd",
    "VAR_POSITIONAL": "star",
    "VAR_KEYWORD": "star-empty",
}


def bullet_for(kind: Column) -> Column:
    chosen = None
    for name, mark in BULLET_BY_KIND.items():
        hit = kind == name
        chosen = F.when(hit, mark) if chosen is None else chosen.when(hit, mark)
    return chosen


def summary_rows(params: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of the signature section: parameters, then exceptions, then the return value.

    Columns: obj, section, pos, bullet, name, doc_type, doc.
    """
    none = F.lit(None).cast("string")
    own = attach_to_params(params, tags).select(
        "obj", F.lit(1).cast("bigint").alias("section"), "pos",
        bullet_for(col("kind")).alias("bullet"), "name", "doc_type", "doc")
    raised = exceptions(tags).select(
        "obj", F.lit(2).cast("bigint").alias("section"), "pos", F.lit("alert").alias("bullet"),
        col("exc_type").alias("name"), none.alias("doc_type"), "doc")
    back = attach_returns(tags).select(
        "obj", F.lit(3).cast("bigint").alias("section"), F.lit(0).cast("bigint").alias("pos"),
        F.lit("right-thin").alias("bullet"), none.alias("name"), "doc_type", "doc")
    return own.unionByName(raised).unionByName(back)
