"""Predicates and labels of documented objects, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import names as N

# Module and class entries that are implementation details.
INTERNAL_NAMES = (
    "__all__", "__builtins__", "__cached__", "__dict__", "__doc__", "__file__", "__loader__",
    "__module__", "__name__", "__package__", "__path__", "__spec__", "__weakref__",
)

# Member category by full type name; everything else is an attribute.
CATEGORY_BY_TYPE = {
    "builtins.builtin_function_or_method": "functions",
    "builtins.classmethod": "functions",
    "builtins.classmethod_descriptor": "functions",
    "builtins.function": "functions",
    "builtins.method_descriptor": "functions",
    "builtins.module": "modules",
    "builtins.property": "properties",
    "builtins.staticmethod": "functions",
    "builtins.type": "types",
    "builtins.wrapper_descriptor": "functions",
    "_ctypes.PyCStructType": "types",
}

# Display labels by builtin type name, spelled as users see them.
LABEL_BY_TYPE = {
    "builtin_function_or_method": "extension function",
    "classmethod": "class method",
    "classmethod_descriptor": "extenson class method",
    "getset_descriptor": "extension property",
    "method_descriptor": "extention method",
    "staticmethod": "static method",
    "wrapper_descriptor": "special method",
}

# Types whose repr says nothing, on terminal rows and on web rows.
PLAIN_REPR_TYPES = ("module", "property", "type")
WEB_REPR_TYPES = (
    "builtin_function_or_method", "classmethod_descriptor", "getset_descriptor",
    "method_descriptor", "module", "property", "type",
)

# Fixed value: longest repr kept.
MAX_REPR = 65_536


def _no(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _choose(key: Column, table: dict[str, str]) -> Column:
    """Lookup in a small fixed table, as one CASE."""
    chosen = None
    for value in dict.fromkeys(table.values()):
        hit = key.isin(*[k for k, v in table.items() if v == value])
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen


def is_visible(name: Column, parent_type: Column, has_all_names: Column, all_names: Column,
               private: bool = False, strict: bool = False) -> Column:
    """Whether a member is listed.

    A module without the `__all__` key hides underscore names; with a list it shows
    the listed names; with a null list it shows everything (with `strict`, a null
    list counts as no key). Other parents show public and dunder names.
    """
    if private:
        return F.lit(True)
    public = ~name.startswith("_")
    dunder = name.startswith("__") & name.endswith("__")
    keyed = _no(has_all_names)
    if strict:
        keyed = keyed & all_names.isNotNull()
    in_module = (
        F.when(~keyed, public).when(all_names.isNull(), F.lit(True))
        .otherwise(F.array_contains(all_names, name))
    )
    return F.when(parent_type == "module", in_module).otherwise(public | dunder)


def is_exported(name: Column, all_names: Column) -> Column:
    """NULL when the module has no `__all__`."""
    return F.when(all_names.isNotNull(), F.array_contains(all_names, name))


def is_internal(name: Column) -> Column:
    return name.isin(*INTERNAL_NAMES)


def member_marks(is_ref: Column, name: Column, exported: Column) -> Column:
    """struct(imported_name, private_name): the two reasons to dim a member."""
    hidden = ~_no(exported)
    return F.struct(
        (is_ref & hidden).alias("imported_name"),
        (_no(name.startswith("_")) & hidden).alias("private_name"),
    )


def is_callable(callable_: Column, func_callable: Column) -> Column:
    """Callable itself or through the function it wraps."""
    return _no(callable_) | _no(func_callable)


def is_function_like(wraps: Column, callable_: Column, type_name: Column,
                     inner_callable: Column, inner_type_name: Column) -> Column:
    """The innermost wrapped object, or the object itself if it wraps none, is callable and not a type."""
    own = _no(callable_) & ~_no(type_name == "type")
    inner = _no(inner_callable) & ~_no(inner_type_name == "type")
    return F.when(F.coalesce(wraps, F.lit(0)) > 0, inner).otherwise(own)


def owns_doc(doc: Column, is_type: Column, type_doc: Column) -> Column:
    """Doc belongs to the object, not to its type."""
    return doc.isNotNull() & (_no(is_type) | ~doc.eqNullSafe(type_doc))


def stored_repr(repr_: Column, is_default: Column) -> Column:
    return F.when(~_no(is_default), F.substr(repr_, F.lit(1), F.lit(MAX_REPR)))


def shows_page_repr(repr_: Column, type_mod: Column, type_qual: Column) -> Column:
    known = F.concat_ws(".", type_mod, type_qual).isin(*CATEGORY_BY_TYPE)
    return repr_.isNotNull() & ~known


def shows_member_repr(repr_: Column, has_signature: Column, type_name: Column,
                      web: bool = False) -> Column:
    plain = type_name.isin(*(WEB_REPR_TYPES if web else PLAIN_REPR_TYPES))
    return repr_.isNotNull() & ~_no(has_signature) & ~_no(plain)


def is_package(name: Column, package: Column) -> Column:
    return _no(name == package)


def display_name(qualname: Column, lookup_qual: Column, name: Column) -> Column:
    """struct(lead, last): the part shown plain and the part shown bold."""
    shown = F.coalesce(qualname, lookup_qual)
    tail = F.coalesce(name, N.last_part(shown))
    ends = _no(shown.endswith(F.concat(F.lit("."), tail)))
    return F.struct(
        F.when(ends, F.substr(shown, F.lit(1), F.length(shown) - F.length(tail)))
        .otherwise("").alias("lead"),
        F.when(ends, tail).otherwise(F.coalesce(shown, name, F.lit("(unnamed object)")))
        .alias("last"),
    )


def display_module(module: Column, lookup_mod: Column) -> Column:
    return F.coalesce(module, lookup_mod)


def source_location(source_file: Column, file: Column, start: Column, end: Column) -> Column:
    """struct(file, first_line, last_line, shown): lines are stored half-open.

    `shown` keeps the displayed form, whose last line is one past the end;
    `last_line` is the real last line, counted from one.
    """
    where = F.coalesce(F.nullif(source_file, F.lit("")), F.nullif(file, F.lit("")))
    return F.struct(
        where.alias("file"),
        (start + 1).alias("first_line"),
        end.alias("last_line"),
        F.when(start.isNotNull(), F.concat(
            F.lit("lines "), (start + 1).cast("string"), F.lit("-"), (end + 1).cast("string")
        )).alias("shown"),
    )


def category(type_mod: Column, type_qual: Column) -> Column:
    """modules, types, properties, functions or attributes."""
    return F.coalesce(
        _choose(F.concat_ws(".", type_mod, type_qual), CATEGORY_BY_TYPE), F.lit("attributes")
    )


def type_label(type_mod: Column, type_qual: Column, name: Column, has_get: Column,
               has_set: Column, has_del: Column) -> Column:
    """Friendly type name, NULL when there is none."""
    accessors = F.concat_ws("/", *[
        F.when(_no(has), F.lit(word)) for has, word in
        ((has_get, "get"), (has_set, "set"), (has_del, "del"))
    ])
    label = (
        F.when(type_qual == "property", F.concat(accessors, F.lit(" property")))
        .when((type_qual == "function") & _no(name == "<lambda>"), F.lit("lambda function"))
        .when(type_qual == "function", F.lit("function"))
        .otherwise(_choose(type_qual, LABEL_BY_TYPE))
    )
    return F.when(type_mod == N.BUILTINS, label)


def page_type_label(label: Column, type_name: Column, type_mod: Column) -> Column:
    shown = F.coalesce(label, type_name)
    foreign = _no(type_mod != N.BUILTINS)
    return F.when(foreign, F.concat(F.lit("instance of "), shown)).otherwise(shown)
