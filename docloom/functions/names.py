"""Dotted names, object paths and refs as Column functions.

An object's key is (modname, qualname); a NULL qualname means the module itself.
Everything here is a plain expression, so it runs inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# One identifier: letter or underscore, then letters, marks, digits, connectors.
IDENTIFIER = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*"

BUILTINS = "builtins"


def null_string() -> Column:
    return F.lit(None).cast("string")


# -- dotted names ---------------------------------------------------------


def join_name(*fragments: Column) -> Column:
    """Dotted name from parts or fragments; NULL when any part comes out empty."""
    joined = F.concat_ws(".", *fragments)
    return F.when(is_dotname(joined), joined)


def join_parts(parts: Column) -> Column:
    """Dotted name from an array of parts, none of which may be empty or dotted."""
    ok = (F.size(parts) > 0) & F.forall(parts, lambda p: (p != "") & ~p.contains("."))
    return F.when(ok, F.array_join(parts, "."))


def is_dotname(name: Column) -> Column:
    return name.rlike(r"^[^.]+(\.[^.]+)*\z")


def is_qualname(name: Column) -> Column:
    return name.rlike(rf"^{IDENTIFIER}(\.{IDENTIFIER})*\z")


def parts(name: Column) -> Column:
    return F.split(name, r"\.")


def n_parts(name: Column) -> Column:
    return F.size(parts(name)).cast("bigint")


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def parent_name(name: Column) -> Column:
    """All but the last part; NULL when there is one part only."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*\z", ""))


def ancestor_names(name: Column) -> Column:
    """Parent, grandparent, ... nearest first; empty for a one-part name."""
    return F.transform(
        F.reverse(_one_to(F.size(parts(name)) - 1)),
        lambda i: _first_parts(name, i),
    )


def prefix_names(name: Column) -> Column:
    """Every prefix, shortest first, ending with the name itself."""
    return F.transform(_one_to(F.size(parts(name))), lambda i: _first_parts(name, i))


def _first_parts(name: Column, n: Column) -> Column:
    return F.call_function("substring_index", name, F.lit("."), n)


def _one_to(n: Column) -> Column:
    # sequence(1, 0) would count down, hence the guard.
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def with_last(name: Column, new: Column) -> Column:
    """Replace the last part; NULL for a one-part name."""
    return F.when(name.contains("."), F.concat_ws(".", parent_name(name), new))


# -- object paths ---------------------------------------------------------


def path(modname: Column, qualname: Column) -> Column:
    """Key struct; NULL when the module name is missing or the qualname is ''."""
    ok = modname.isNotNull() & (modname != "") & (qualname.isNull() | (qualname != ""))
    return F.when(ok, F.struct(modname.alias("modname"), qualname.alias("qualname")))


def full_name(modname: Column, qualname: Column) -> Column:
    return F.concat_ws(".", modname, qualname)


def child(qualname: Column, name: Column) -> Column:
    return F.concat_ws(".", qualname, name)


def mangle(qualname: Column) -> Column:
    """Private-mangled form of a member's qualname; NULL where the rule does not apply."""
    private = qualname.rlike(r"\.__[^.]*\z")
    return F.when(
        private, F.regexp_replace(qualname, r"([^.]*)\.(__[^.]*)\z", "$1._$1$2")
    )


def unmangle(name: Column) -> Column:
    """struct(parent, name): the class guessed from `_Class__x`, and `__x`."""
    rest = F.substr(name, F.lit(2))
    at = F.instr(rest, "__")
    mangled = name.startswith("_") & ~name.startswith("__") & (at > 0)
    return F.struct(
        F.when(mangled, F.substr(rest, F.lit(1), at - 1)).alias("parent"),
        F.when(mangled, F.substr(rest, at)).otherwise(name).alias("name"),
    )


def own_path(ref: Column, type_name: Column, name: Column, module_ref: Column,
             qualname: Column) -> Column:
    """Path of a document node: a ref's target, a module's name, or module + qualname."""
    return (
        F.when(ref.isNotNull(), parse_ref(ref))
        .when(type_name == "module", path(name, null_string()))
        .when(
            module_ref.isNotNull() & qualname.isNotNull(),
            path(parse_ref(module_ref)["modname"], qualname),
        )
    )


def claimed_path(is_module: Column, name: Column, module: Column, qualname: Column) -> Column:
    """The path an object reports for itself, NULL when it reports none."""
    return F.when(is_module & name.isNotNull(), path(name, null_string())).when(
        module.isNotNull() & qualname.isNotNull(), path(module, qualname)
    )


# -- refs -----------------------------------------------------------------


def make_ref(modname: Column, qualname: Column) -> Column:
    tail = F.concat(F.lit("/dict/"), F.replace(qualname, F.lit("."), F.lit("/dict/")))
    return F.concat(F.lit("#/modules/"), modname, F.coalesce(tail, F.lit("")))


def is_ref(ref: Column) -> Column:
    return ref.isNotNull()


def parse_ref(ref: Column) -> Column:
    """Key struct of a ref; NULL when it is malformed."""
    ok = ref.rlike(r"^#/modules/[^/]+((/dict/[^/]*)+(/dict)?)?\z")
    tail = F.regexp_extract(ref, r"^#/modules/[^/]+(.*)", 1)
    dotted = F.regexp_replace(F.regexp_replace(tail, r"/dict/([^/]*)", ".$1"), r"/dict\z", "")
    qualname = F.when(tail != "", F.substr(dotted, F.lit(2)))
    modname = F.regexp_extract(ref, r"^#/modules/([^/]+)", 1)
    return F.when(ok, path(modname, qualname))


def typed_ref(modname: Column, qualname: Column, type_mod: Column, type_qual: Column) -> Column:
    """A ref that also carries a ref to the target's type."""
    return F.struct(
        make_ref(modname, qualname).alias("ref"), make_ref(type_mod, type_qual).alias("type_ref")
    )


# -- display --------------------------------------------------------------


def is_subpath(file_path: Column, root: Column) -> Column:
    """Containment by path components, equality included."""
    base = F.regexp_replace(root, r"/+\z", "")
    return (file_path == root) | file_path.startswith(F.concat(base, F.lit("/")))


def context_name(modname: Column, qualname: Column, context: Column | None = None) -> Column:
    """Full name with the module left out for builtins and the context module."""
    hidden = modname == BUILTINS
    if context is not None:
        hidden = hidden | F.coalesce(modname == context, F.lit(False))
    return F.concat_ws(".", F.when(~(hidden & qualname.isNotNull()), modname), qualname)


def relative_name(modname: Column, qualname: Column, rel_mod: Column, rel_qual: Column,
                  name: Column | None = None) -> Column:
    """Name as seen from (rel_mod, rel_qual), optionally with another last part."""
    if name is not None:
        renamed = F.when(
            qualname.contains("."), F.concat_ws(".", parent_name(qualname), name)
        ).otherwise(name)
        qualname = F.when(name.isNotNull(), renamed).otherwise(qualname)
    same = F.coalesce(rel_mod == modname, F.lit(False)) & qualname.isNotNull()
    inside = F.coalesce(
        qualname.startswith(F.concat(rel_qual, F.lit("."))), F.lit(False)
    )
    drop = (same & (rel_qual.isNull() | inside)) | (modname == BUILTINS)
    shown = F.when(same & inside, F.substr(qualname, F.length(rel_qual) + 2)).otherwise(qualname)
    return F.concat_ws(".", F.when(~drop, modname), shown)


def page_link(modname: Column, qualname: Column) -> Column:
    return F.concat(F.lit("/"), modname, F.lit("/"), F.coalesce(qualname, F.lit("")))


def tree_label(modname: Column) -> Column:
    """Indented label of a module in the module tree."""
    depth = (F.size(parts(modname)) - 1).cast("int")
    sub = F.concat(F.repeat(F.lit(" "), depth * 2), F.lit("."), last_part(modname))
    return F.when(depth > 0, sub).otherwise(modname)


def if_null(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)
