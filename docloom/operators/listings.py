"""Member rows, object pages and documentation enrichment, composed from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.functions import objects as O
from docloom.functions import text as X
from docloom.functions.arrays import let
from docloom.operators import refs as R
from docloom.operators.signatures import signature_text

col = F.col


# -- enrichment -----------------------------------------------------------


def _last(tags: Column, tag: str, arg: Column | None = None) -> Column:
    """Text of the last such tag, NULL when there is none."""
    same = lambda t: (t["tag"] == tag) & (
        F.lit(True) if arg is None else t["arg"].eqNullSafe(arg))
    hits = F.filter(tags, same)
    return let(hits, lambda h: F.get(h, F.size(h) - 1)["text"])


def enrich(objects: DataFrame, doc: str = "doc", params: str = "params") -> DataFrame:
    """Add the parsed documentation and the documented signature of every object, once.

    Adds `docs` (doc, summary, body, tags) and `documented`: params with doc and
    doc_type, the return's doc and doc_type, exceptions, and the tags that match no
    parameter. A docstring and its signature stand in one row, so nothing moves.
    """
    with_docs = objects.withColumn("docs", X.parse_doc(col(doc)))
    tags = F.coalesce(
        col("docs.tags"), F.array().cast("array<struct<tag:string,arg:string,text:string>>"))

    def attach(ts):
        names = F.transform(col(params), lambda p: p["name"])
        return F.struct(
            F.transform(col(params), lambda p: F.struct(
                p["pos"].alias("pos"), p["name"].alias("name"), p["kind"].alias("kind"),
                _last(ts, "param", p["name"]).alias("doc"),
                _last(ts, "type", p["name"]).alias("doc_type"),
            )).alias("params"),
            _last(ts, "return").alias("return_doc"),
            _last(ts, "rtype").alias("return_type"),
            F.transform(F.filter(ts, lambda t: t["tag"] == "raise"), lambda t: F.struct(
                t["arg"].alias("exc_type"), t["text"].alias("doc"))).alias("exceptions"),
            F.filter(ts, lambda t: t["tag"].isin("param", "type") & ~F.coalesce(
                F.array_contains(names, t["arg"]), F.lit(False))).alias("unmatched"),
        )

    return with_docs.withColumn("documented", let(tags, attach))


# -- member rows ----------------------------------------------------------


def member_rows(members: DataFrame, objects: DataFrame, web: bool = False,
                ends: DataFrame | None = None) -> DataFrame:
    """One display row per member, refs read through to what they lead to.

    `members`: parent_mod, parent_qual, member_name, is_ref, target_mod, target_qual.
    `objects`: modname, qualname, type_mod, type_qual, type_name, name, has_get,
    has_set, has_del, params, function_like, repr, summary, body. A ref that leads
    nowhere keeps its own row, without details. `ends`: what `refs.resolve_refs`
    gives for the refs among the members, where it is known.
    """
    place_qual = N.child(col("parent_qual"), col("member_name"))
    refs = members.filter("is_ref").select(
        col("parent_mod").alias("modname"), place_qual.alias("qualname"), "target_mod", "target_qual")
    ends = (R.resolve_refs(refs) if ends is None else ends).select(
        col("modname").alias("_m"), col("qualname").alias("_n"), "final_mod", "final_qual")
    led = members.join(
        ends, (col("parent_mod") == col("_m")) & (place_qual == col("_n")) & col("is_ref"), "left",
    ).drop("_m", "_n")
    at_mod = F.when(col("is_ref"), F.coalesce("final_mod", "target_mod")).otherwise(col("parent_mod"))
    at_qual = F.when(
        col("is_ref"), F.when(col("final_mod").isNotNull(), col("final_qual")).otherwise(col("target_qual"))
    ).otherwise(place_qual)
    details = [c for c in objects.columns if c not in ("modname", "qualname")]
    right = objects.select(
        col("modname").alias("_om"), F.coalesce("qualname", F.lit("")).alias("_oq"), *details)
    full = led.withColumn("_am", at_mod).withColumn("_aq", F.coalesce(at_qual, F.lit(""))).join(
        right, (col("_am") == col("_om")) & (col("_aq") == col("_oq")), "left")
    plain = N.unmangle(col("member_name"))
    shows = O.shows_member_repr(col("repr"), col("params").isNotNull(), col("type_name"), web=web)
    return full.select(
        "parent_mod", "parent_qual", "member_name", "is_ref",
        plain["name"].alias("plain_name"),
        plain["parent"].alias("mangled_for"),
        F.when(F.coalesce("function_like", F.lit(False)), signature_text(col("params")))
        .alias("signature"),
        F.coalesce(
            O.type_label(col("type_mod"), col("type_qual"), col("name"),
                         col("has_get"), col("has_set"), col("has_del")),
            col("type_name")).alias("type_label"),
        F.when(col("is_ref"), N.context_name(
            col("target_mod"), col("target_qual"), col("parent_mod"))).alias("import_path"),
        F.when(shows, col("repr")).alias("repr"),
        "summary",
        F.coalesce(F.length("body") > 0, F.lit(False)).alias("has_more"),
        O.category(col("type_mod"), col("type_qual")).alias("category"),
    )


# -- pages ----------------------------------------------------------------

# Order of the member sections, with titles inside a module and elsewhere.
MEMBER_SECTIONS = (
    ("modules", "Modules", "Modules"),
    ("types", "Types", "Member Types"),
    ("properties", "Properties", "Properties"),
    ("functions", "Functions", "Methods"),
    ("attributes", "Attributes", "Attributes"),
)


def page_rows(objects: DataFrame, rows: DataFrame, signature_rows: DataFrame,
              bases: DataFrame) -> DataFrame:
    """Pages as rows: modname, qualname, section, title, key, json.

    A page is its rows in order of (section, key). Keeping it as rows means that the
    page of a module with very many members is never put together in one task.
    """
    def page(df, section, title, key, *fields):
        return df.select(
            "modname", "qualname", F.lit(section).cast("bigint").alias("section"),
            title.alias("title"), key.alias("key"), F.to_json(F.struct(*fields)).alias("json"))

    blank = F.lit("")
    number = lambda c: F.lpad(c.cast("string"), 19, "0")
    head = page(
        objects, 0, F.lit("Head"), blank, "name", "qualname", "modname", "type_name", "repr")
    docs = page(
        objects.filter("summary IS NOT NULL"), 2, F.lit("Documentation"), blank, "summary", "body")
    types = page(bases, 3, F.lit("Type"), number(col("pos")), "base_mod", "base_qual")
    signed = page(
        signature_rows, 4, F.lit("Parameters"),
        F.concat_ws(".", col("section"), number(col("pos"))),
        col("section").alias("part"), "bullet", "name", "doc_type", "doc")
    order, title = None, None
    for i, (word, in_module, elsewhere) in enumerate(MEMBER_SECTIONS, 5):
        hit = col("category") == word
        named = F.when(col("parent_qual").isNull(), in_module).otherwise(elsewhere)
        order = F.when(hit, i) if order is None else order.when(hit, i)
        title = F.when(hit, named) if title is None else title.when(hit, named)
    listed = rows.select(
        col("parent_mod").alias("modname"), col("parent_qual").alias("qualname"),
        order.cast("bigint").alias("section"), title.alias("title"),
        col("member_name").alias("key"),
        F.to_json(F.struct(
            "plain_name", "signature", "type_label", "import_path", "repr", "summary", "has_more"
        )).alias("json"))
    every = head
    for part in (docs, types, signed, listed):
        every = every.unionByName(part)
    return every


def write_pages(pages: DataFrame, path: str) -> None:
    """JSON lines in page order."""
    pages.orderBy("modname", "qualname", "section", "key").write.mode("errorifexists").json(path)
