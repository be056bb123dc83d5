"""From a table of source texts to documented objects, refs and pages, without running any code.

Names in a module are resolved as Python does: the class body that an expression stands in,
then the module, then what the module imports by `*`, then builtins. What a name leads to is
followed through refs at any depth. Every step is an equi-join on (module, name), and names
asked for often are asked once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.functions import objects as O
from docloom.functions.generate import explode_rows
from docloom.operators import listings as L
from docloom.operators import refs as R
from docloom.operators import signatures as S
from docloom.session import written
from docloom.sources import extract as E

col = F.col

# A name, or names joined by dots, as an expression.
NAME = r"^[^\W\d]\w*(\.[^\W\d]\w*)*$"


@dataclass
class Corpus:
    """Tables of a set of modules.

    objects: modname, qualname, name, type_mod, type_qual, type_name, callable, function_like,
    repr, source_file, line_start, line_end, doc, has_all_names, all_names, has_get, has_set,
    has_del, params. refs: modname, qualname, target_mod, target_qual. members: rows for
    `listings.member_rows`, with `exported`. bases: modname, qualname, pos, base_mod, base_qual.
    annotations: modname, qualname, pos, target_mod, target_qual. failed: modname, path, problem.
    ends: what `refs.resolve_refs` gives for refs.
    """

    objects: DataFrame
    refs: DataFrame
    members: DataFrame
    bases: DataFrame
    annotations: DataFrame
    failed: DataFrame
    ends: DataFrame


def resolve_uses(uses: DataFrame, places: DataFrame, refs: DataFrame, objects: DataFrame,
                 ends: DataFrame | None = None) -> DataFrame:
    """Add target_mod and target_qual to uses (modname, owner, name): what the name leads to there.

    `places` (modname, qualname): every bound name, refs included. A name that leads out of the
    known modules gets the path that the refs give; one that nothing binds is a builtin. A null
    name leads nowhere. `ends`: what `refs.resolve_refs` gives for `refs`, where it is known.
    """
    asked = uses.select("modname", "owner", "name").filter("name IS NOT NULL").distinct()
    head = F.substring_index("name", ".", 1)
    scopes = F.filter(
        F.array(F.when(col("owner").isNotNull(), N.child(col("owner"), head)), head), lambda s: s.isNotNull())
    tried = explode_rows(asked, ["modname", "owner", "name"], scopes, "qualname", pos="_rank")
    found = tried.join(places.select("modname", "qualname").filter("qualname IS NOT NULL"),
                       ["modname", "qualname"], "left_semi")
    # A number is kept in a hash aggregate, a name would have to be sorted.
    heads = found.groupBy("modname", "owner", "name").agg(F.min("_rank").alias("_rank")).withColumn(
        "_head", F.get(scopes, col("_rank").cast("int")))
    rest = F.substr("name", F.length(F.substring_index("name", ".", 1)) + 1)
    paths = written(heads.select("modname", "owner", "name", "_head", F.concat("_head", rest).alias("qualname"),
                                 rest.alias("_rest")))
    wide = refs.withColumnRenamed("qualname", "member_name")
    ends = written(R.resolve_refs(refs)) if ends is None else ends
    met = R.look_up_through(
        paths.select("modname", "qualname").distinct(), objects, wide, ends.withColumnRenamed("qualname", "member_name")
    ).filter("status = 'found'").select(
        "modname", "qualname", "found_mod", "found_qual", F.lit(True).alias("_found"))
    ends = ends.filter("NOT is_cycle").select(
        "modname", col("qualname").alias("_head"), "final_mod", "final_qual")
    out = F.nullif(F.ltrim(F.concat(F.coalesce("final_qual", F.lit("")), "_rest"), F.lit(".")), F.lit(""))
    known = paths.join(met, ["modname", "qualname"], "left").join(ends, ["modname", "_head"], "left").select(
        "modname", "owner", "name", F.lit(True).alias("_known"),
        F.when(col("_found"), col("found_mod")).otherwise(F.coalesce("final_mod", "modname")).alias("_mod"),
        F.when(col("_found"), col("found_qual")).otherwise(
            F.when(col("final_mod").isNotNull(), out).otherwise(col("qualname"))).alias("_qual"))
    keyed = known.select(col("modname").alias("_m"), col("owner").alias("_o"), col("name").alias("_n"), "_known", "_mod", "_qual")
    same = (col("modname") == col("_m")) & col("owner").eqNullSafe(col("_o")) & (col("name") == col("_n"))
    return uses.join(keyed, same, "left").select(
        *[col(c) for c in uses.columns],
        F.when(col("_known"), col("_mod")).when(col("name").isNotNull(), F.lit(N.BUILTINS)).alias("target_mod"),
        F.when(col("_known"), col("_qual")).otherwise(col("name")).alias("target_qual"))


def _uses(bound: DataFrame, *roles: str) -> DataFrame:
    return explode_rows(bound.filter("uses IS NOT NULL"), ["modname", "qualname", "owner"], col("uses"), "u").select(
        "modname", "qualname", "owner", "u.role", "u.name").filter(col("role").isin(*roles))


def build(sources: DataFrame, packages: DataFrame | None = None) -> Corpus:
    """Tables of all sources (modname, path, source). `packages` (modname) names the modules that
    are packages, whose relative imports start at themselves."""
    raw = written(E.parse_sources(sources))
    good, failed = E.split_errors(raw)
    bound = E.bindings(good)
    modules = bound.filter("kind = 'module'").select("modname")
    stars = E.star_aliases(good, packages)
    keys = bound.select("modname", col("qualname").alias("member_name"))
    # What a module binds itself goes before what `*` brings.
    edges = E.settle_module_targets(
        E.aliases(bound, packages).unionByName(stars.join(keys, ["modname", "member_name"], "left_anti")), modules)
    imports = written(edges.withColumnRenamed("member_name", "qualname"))
    plain = E.objects(bound)
    places = written(plain.select("modname", "qualname").unionByName(imports.select("modname", "qualname")))

    # `a = b`: a ref, if it leads to a function or class or out of the corpus; else a value like b.
    same = written(resolve_uses(_uses(bound, "same"), places, imports, places).filter(
        col("target_mod") != N.BUILTINS).select("modname", "qualname", "target_mod", "target_qual"))
    candidates = written(imports.unionByName(same))
    ends = R.resolve_refs(candidates).filter("NOT is_cycle").select("modname", "qualname", "final_mod", "final_qual")
    values = plain.filter(F.coalesce(~col("type_name").isin("type", "module", "function", *E.WRAPPERS), F.lit(True)))
    copies = ends.join(same.select("modname", "qualname"), ["modname", "qualname"], "left_semi").join(
        values.select(col("modname").alias("final_mod"), col("qualname").alias("final_qual"), col("type_name").alias("_type")),
        ["final_mod", "final_qual"])
    copies = written(copies.select("modname", "qualname", "_type"))
    refs = written(candidates.join(copies, ["modname", "qualname"], "left_anti"))
    objects = plain.join(refs.select("modname", "qualname"), ["modname", "qualname"], "left_anti").join(
        copies, ["modname", "qualname"], "left").withColumn("type_name", F.coalesce("type_name", "_type")).drop("_type")
    objects = written(objects)
    places = written(objects.select("modname", "qualname"))
    everywhere = places.unionByName(refs.select("modname", "qualname"))

    ref_ends = written(R.resolve_refs(refs))

    bases = explode_rows(objects, ["modname", "qualname", "owner"], col("bases"), "name").filter(col("name").rlike(NAME))
    told = explode_rows(objects, ["modname", "qualname", "owner"], col("signature.params"), "p").select(
        "modname", "qualname", "owner", col("p.pos").alias("pos"), col("p.annotation").alias("name")).filter(col("name").rlike(NAME))
    # One pass of joins for every kind of use.
    uses = written(resolve_uses(
        _uses(objects, "type", "get", "func").withColumn("pos", F.lit(None).cast("bigint"))
        .unionByName(bases.withColumn("role", F.lit("base"))).unionByName(told.withColumn("role", F.lit("annotation"))),
        everywhere, refs, places, ref_ends))
    placed = ["modname", "qualname", "pos"]
    detailed = _with_uses(objects, uses)
    exports = written(E.exports(good))
    return Corpus(
        objects=written(_finished(detailed, exports, bound)), refs=refs,
        members=_members(objects, refs, exports),
        bases=uses.filter("role = 'base'").select(*placed, col("target_mod").alias("base_mod"), col("target_qual").alias("base_qual")),
        annotations=uses.filter("role = 'annotation'").select(*placed, "target_mod", "target_qual"),
        failed=failed, ends=ref_ends)


def _with_uses(objects: DataFrame, uses: DataFrame) -> DataFrame:
    """Types of called classes, and documentation and signatures of wrapped functions."""
    kinds = objects.select(col("modname").alias("target_mod"), col("qualname").alias("target_qual"),
                           col("type_name").alias("_kind"), col("doc").alias("_doc"), col("signature").alias("_signature"))
    hit = uses.filter(col("role").isin("type", "get", "func")).join(kinds, ["target_mod", "target_qual"], "left")
    builtin = (col("target_mod") == N.BUILTINS) & col("target_qual").isin(*BUILTIN_TYPES)
    is_type = (col("role") == "type") & ((col("_kind") == "type") | builtin)
    found = hit.groupBy("modname", "qualname").agg(
        F.max_by(F.struct("target_mod", "target_qual"), F.when(is_type, 1)).alias("_made"),
        F.max_by(F.struct("_doc", "_signature"), F.when(col("role") != "type", 1)).alias("_inner"))
    own = col("type_name").isin(*E.WRAPPERS)
    # Modules have a null name, which no use has.
    return objects.join(found, ["modname", "qualname"], "left").select(
        *[c for c in objects.columns if c not in ("type_mod", "type_name", "doc", "signature")],
        F.coalesce("_made.target_mod", "type_mod").alias("type_mod"),
        F.coalesce("_made.target_qual", "type_name").alias("type_qual"),
        F.coalesce(N.last_part(col("_made.target_qual")), "type_name").alias("type_name"),
        F.coalesce("doc", F.when(own, col("_inner._doc"))).alias("doc"),
        F.coalesce("signature", F.when(own, col("_inner._signature"))).alias("signature"))


# Builtin classes that are called to make a value.
BUILTIN_TYPES = ("bool", "bytearray", "bytes", "complex", "dict", "float", "frozenset", "int", "list", "object", "range",
                 "set", "slice", "str", "tuple")


def _finished(objects: DataFrame, exports: DataFrame, bound: DataFrame) -> DataFrame:
    """With `__all__`, parameters, and what can be called."""
    has = bound.filter("qualname = '__all__'").select("modname", F.lit(True).alias("_has"))
    listed = objects.join(exports, "modname", "left").join(has, "modname", "left")
    module = col("type_name") == "module"
    wraps = col("type_name").isin("staticmethod", "classmethod")
    params = F.transform("signature.params", lambda p: F.struct(
        p["pos"].alias("pos"), p["name"].alias("name"), p["kind"].alias("kind"),
        p["default_repr"].alias("default_repr"), p["annotation"].alias("annotation")))
    return listed.select(
        "modname", "qualname", "name", "type_mod", "type_qual", "type_name", "callable",
        (F.coalesce(wraps | (col("type_name") == "function"), F.lit(False))).alias("function_like"),
        "repr", "source_file", "line_start", "line_end", "doc",
        F.when(module, F.coalesce("_has", F.lit(False))).alias("has_all_names"),
        F.when(module, col("all_names")).alias("all_names"), "has_get", "has_set", "has_del",
        # A property shows no signature of its own.
        F.when(col("type_name") != "property", params).alias("params"))


def _members(objects: DataFrame, refs: DataFrame, exports: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    own = objects.filter("qualname IS NOT NULL").select(
        col("modname").alias("parent_mod"), N.parent_name(col("qualname")).alias("parent_qual"),
        N.last_part(col("qualname")).alias("member_name"), F.lit(False).alias("is_ref"),
        none.alias("target_mod"), none.alias("target_qual"))
    led = refs.select(
        col("modname").alias("parent_mod"), N.parent_name(col("qualname")).alias("parent_qual"),
        N.last_part(col("qualname")).alias("member_name"), F.lit(True).alias("is_ref"), "target_mod", "target_qual")
    listed = exports.withColumnRenamed("modname", "parent_mod")
    return own.unionByName(led).join(listed, "parent_mod", "left").select(
        "parent_mod", "parent_qual", "member_name", "is_ref", "target_mod", "target_qual",
        F.when(col("parent_qual").isNull(), O.is_exported(col("member_name"), col("all_names"))).alias("exported"))


def pages(corpus: Corpus) -> DataFrame:
    """Pages of all objects, as `listings.page_rows` gives them."""
    rich = L.enrich(corpus.objects).withColumn("summary", col("docs.summary")).withColumn("body", col("docs.body"))
    details = written(rich.drop("docs"))
    rows = L.member_rows(corpus.members, details, ends=corpus.ends)
    documented = explode_rows(
        details, ["modname", "qualname", "params"], col("documented.params"), "d", pos="_at"
    ).select("modname", "qualname", col("d.pos").alias("pos"), col("d.kind").alias("kind"), "d.name",
             col("d.doc_type").alias("doc_type"), "d.doc", F.get("params", col("_at").cast("int"))["annotation"].alias("_told"))
    leads = corpus.annotations.select("modname", "qualname", "pos", N.context_name(
        col("target_mod"), col("target_qual"), col("modname")).alias("_shown"))
    signed = documented.join(leads, ["modname", "qualname", "pos"], "left").select(
        "modname", "qualname", F.lit(1).cast("bigint").alias("section"), "pos", S.bullet_for(col("kind")).alias("bullet"),
        "name", F.coalesce("doc_type", "_shown", "_told").alias("doc_type"), "doc")
    return L.page_rows(details, rows, signed, corpus.bases)


def pages_of(names: DataFrame, corpus: Corpus, rows: DataFrame) -> DataFrame:
    """The pages (of `rows`) of the objects that dotted names (column `name`) lead to, refs followed."""
    refs = corpus.refs.withColumnRenamed("qualname", "member_name")
    known = corpus.objects.select("modname", "qualname").unionByName(corpus.refs.select("modname", "qualname"))
    asked = R.resolve_names(names, known).filter("modname IS NOT NULL").select(
        "name", col("modname").alias("_am"), col("qualname").alias("_aq"))
    ends = R.look_up_through(
        asked.select(col("_am").alias("modname"), col("_aq").alias("qualname")).distinct(), corpus.objects, refs,
        corpus.ends.withColumnRenamed("qualname", "member_name")
    ).filter("status = 'found'").select(
        col("modname").alias("_em"), col("qualname").alias("_eq"), "found_mod", "found_qual")
    led = asked.join(ends, (col("_am") == col("_em")) & col("_aq").eqNullSafe(col("_eq")))
    return rows.join(
        led.select("name", "found_mod", "found_qual"),
        (col("modname") == col("found_mod")) & col("qualname").eqNullSafe(col("found_qual"))
    ).drop("found_mod", "found_qual")
