"""Source text to object rows.

Python workers only parse: one pass over a module's syntax tree gives one raw row
per definition. What the rows mean - labels, visibility, refs, resolution - is
worked out by DataFrame operators afterwards. No analysed code is imported or run.
"""

from __future__ import annotations

import ast
import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions import names as N
from docloom.functions import objects as O
from docloom.functions.generate import explode_rows
from docloom.operators.signatures import SIGNATURE, param_rows, source_of
from docloom.session import written

col = F.col

RAW = T.StructType([
    T.StructField("modname", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("qualname", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line_start", T.LongType()),
    T.StructField("line_end", T.LongType()),
    T.StructField("doc", T.StringType()),
    T.StructField("bases", T.ArrayType(T.StringType())),
    T.StructField("all_names", T.ArrayType(T.StringType())),
    T.StructField("target", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("signature", SIGNATURE),
    T.StructField("pos", T.LongType()),
    T.StructField("owner", T.StringType()),
    T.StructField("fallback", T.BooleanType()),
    T.StructField("attached", T.BooleanType()),
    T.StructField("value_type", T.StringType()),
    T.StructField("uses", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("name", T.StringType())]))),
])

# Sources handed to a worker at a time; object rows, and characters of sources, handed back at a time.
SOURCES_PER_BATCH = 200
ROWS_PER_BATCH = 2_000
CHARS_PER_BATCH = 1 << 22

# Decorators that change what a function is, property accessors, and the
# arguments of `property` in order.
WRAPPERS = ("classmethod", "staticmethod", "property")
ACCESSORS = ("getter", "setter", "deleter")
PROPERTY_ARGS = {"fget": "get", "fset": "set", "fdel": "del", "doc": "doc"}
# Names that are false when a module is imported.
NEVER = ("TYPE_CHECKING", "typing.TYPE_CHECKING")


def _mangled(name: str, cls: str | None) -> str:
    """The key under which a class body stores a private name."""
    bare = (cls or "").lstrip("_")
    private = bare and name.startswith("__") and not name.endswith("__")
    return f"_{bare}{name}" if private else name


def _dotted(node, cls: str | None) -> str | None:
    """`a.b.c` of a plain name expression."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(_mangled(node.attr, cls))
        node = node.value
    return ".".join([_mangled(node.id, cls), *parts[::-1]]) if isinstance(node, ast.Name) else None


def _decorated(node, cls) -> dict:
    """What the decorators make of a function."""
    for item in node.decorator_list:
        if isinstance(item, ast.Name) and item.id in WRAPPERS:
            return {"kind": item.id}
        if isinstance(item, ast.Attribute) and item.attr in ACCESSORS:
            return {"kind": item.attr, "uses": _uses([("of", _dotted(item.value, cls))])}
    return {"kind": "function"}


def _uses(pairs) -> list[dict]:
    return [{"role": r, "name": n} for r, n in pairs]


def _signed(args, returns=None) -> dict:
    return {"params": param_rows(args), "return_annotation": None if returns is None else source_of(returns)}


def _meaning(node, cls) -> dict:
    """What an assigned expression is, as far as it can be told without running it."""
    if isinstance(node, ast.Lambda):
        return {"kind": "function", "name": "<lambda>", "signature": _signed(node.args)}
    if isinstance(node, ast.Call):
        called = _dotted(node.func, cls)
        if called == "property":
            args = [*zip(PROPERTY_ARGS.values(), node.args),
                    *((PROPERTY_ARGS.get(k.arg), k.value) for k in node.keywords)]
            doc = next((v.value for r, v in args if r == "doc" and isinstance(v, ast.Constant)), None)
            given = [(r, v) for r, v in args if r in ("get", "set", "del")
                     and not (isinstance(v, ast.Constant) and v.value is None)]
            return {"kind": "property", "doc": doc, "uses": _uses((r, _dotted(v, cls)) for r, v in given)}
        if called in ("staticmethod", "classmethod") and len(node.args) == 1:
            inner = node.args[0]
            made = {"kind": called, "uses": _uses([("func", _dotted(inner, cls))])}
            return made | ({"signature": _signed(inner.args)} if isinstance(inner, ast.Lambda) else {})
        return {"uses": _uses([("type", called)])} if called else {}
    if (name := _dotted(node, cls)) is not None:
        return {"uses": _uses([("same", name)])}
    if isinstance(node, ast.Constant):
        return {"value_type": type(node.value).__name__}
    literal = {ast.List: "list", ast.Tuple: "tuple", ast.Dict: "dict", ast.Set: "set", ast.JoinedStr: "str",
               ast.ListComp: "list", ast.SetComp: "set", ast.DictComp: "dict", ast.GeneratorExp: "generator"}
    return {"value_type": literal.get(type(node))}


def _strings(node, known: dict) -> list[str] | None:
    """The strings of a list or tuple expression; None where it cannot be worked out."""
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        out = []
        for e in node.elts:
            part = ([e.value] if isinstance(e, ast.Constant) and isinstance(e.value, str)
                    else _strings(e.value, known) if isinstance(e, ast.Starred) else None)
            if part is None:
                return None
            out += part
        return out
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        left, right = _strings(node.left, known), _strings(node.right, known)
        return None if left is None or right is None else left + right
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1:
        inner = _strings(node.args[0], known)
        return inner if inner is None or node.func.id in ("list", "tuple") else (
            sorted(inner) if node.func.id == "sorted" else None)
    return known.get(node.id) if isinstance(node, ast.Name) else None


def _truth(test) -> bool | None:
    """Whether a condition is certain when a module is imported."""
    if isinstance(test, ast.Constant):
        return bool(test.value)
    if _dotted(test, None) in NEVER:
        return False
    main = isinstance(test, ast.Compare) and _dotted(test.left, None) == "__name__"
    return False if main and isinstance(test.ops[0], ast.Eq) else None


class _Bindings:
    """Raw rows of one module, in the order in which its statements bind names."""

    def __init__(self, modname, path):
        self.base = dict.fromkeys(RAW.names) | {"modname": modname, "path": path, "fallback": False, "attached": False}
        self.rows: list[dict] = []
        # String lists by name, at the top level.
        self.lists: dict[str, list[str] | None] = {}

    def add(self, owner, cls, key, node, fallback, **fields):
        key = _mangled(key, cls)
        row = self.base | {"qualname": f"{owner}.{key}" if owner else key, "name": key, "owner": owner or None,
                           "pos": len(self.rows), "fallback": fallback,
                           "line_start": node.lineno - 1, "line_end": node.end_lineno}
        self.rows.append(row | fields)

    def body(self, body, owner="", cls=None, fallback=False):
        for node in body:
            self.statement(node, owner, cls, fallback)

    def statement(self, node, owner, cls, fallback):
        here = (owner, cls)
        if isinstance(node, ast.ClassDef):
            first = [d.lineno for d in node.decorator_list]
            qualname = f"{owner}.{_mangled(node.name, cls)}" if owner else node.name
            self.add(*here, node.name, node, fallback, kind="type", name=node.name,
                     line_start=min([node.lineno, *first]) - 1, doc=ast.get_docstring(node, clean=False),
                     bases=[source_of(b) for b in node.bases])
            self.body(node.body, qualname, node.name, fallback)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first = [d.lineno for d in node.decorator_list]
            self.add(*here, node.name, node, fallback, name=node.name, line_start=min([node.lineno, *first]) - 1,
                     doc=ast.get_docstring(node, clean=False), signature=_signed(node.args, node.returns),
                     **_decorated(node, cls))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for alias in node.names:
                plain = isinstance(node, ast.Import)
                name = alias.asname or (alias.name.split(".")[0] if plain else alias.name)
                target = ((alias.name if alias.asname else name) if plain else f"{node.module or ''}:{alias.name}")
                self.add(*here, name, node, fallback, kind="import", target=target, level=0 if plain else node.level)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            self.walrus(node.value, *here, fallback)
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(node, ast.AnnAssign) and node.value is None:
                    continue
                self.assign(target, node.value, node, *here, fallback)
        elif isinstance(node, ast.AugAssign):
            self.augment(node, *here, fallback)
        elif isinstance(node, ast.Delete):
            for target in node.targets:
                if (name := _dotted(target, cls)) is not None and not fallback:
                    up, _, key = name.rpartition(".")
                    self.add(f"{owner}.{up}" if owner and up else owner or up, None, key, node, False, kind="delete")
        elif isinstance(node, (ast.If, ast.While)):
            self.walrus(node.test, *here, fallback)
            certain = _truth(node.test)
            if certain is not False:
                self.body(node.body, *here, fallback)
            if certain is not True:
                self.body(node.orelse, *here, fallback)
        else:
            self.other(node, *here, fallback)

    def other(self, node, owner, cls, fallback):
        """Compound statements, and names that a statement binds besides."""
        here = (owner, cls)
        targets = [node.target] if isinstance(node, (ast.For, ast.AsyncFor)) else []
        targets += [i.optional_vars for i in getattr(node, "items", ()) if getattr(i, "optional_vars", None)]
        targets += [node.name] if isinstance(node, ast.TypeAlias) else []
        for target in targets:
            self.assign(target, None, node, *here, fallback)
        if isinstance(node, ast.Expr):
            self.walrus(node.value, *here, fallback)
            self.changed_list(node, *here, fallback)
        for inner in ("body", "orelse", "finalbody"):
            self.body(getattr(node, inner, []), *here, fallback)
        for part in getattr(node, "cases", ()):
            for leaf in ast.walk(part.pattern):
                if name := getattr(leaf, "name", None) or getattr(leaf, "rest", None):
                    self.add(*here, name, leaf, fallback, kind="value")
            self.body(part.body, *here, fallback)
        # What a handler binds counts only where nothing else binds the name.
        for part in getattr(node, "handlers", ()):
            self.body(part.body, *here, True)

    def assign(self, target, value, node, owner, cls, fallback):
        if isinstance(target, ast.Starred):
            target, value = target.value, None
        if isinstance(target, (ast.Tuple, ast.List)):
            paired = (isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts)
                      and not any(isinstance(e, ast.Starred) for e in (*value.elts, *target.elts)))
            for i, part in enumerate(target.elts):
                self.assign(part, value.elts[i] if paired else None, node, owner, cls, fallback)
            return
        fields = {"kind": "value"}
        if value is not None:
            fields |= {"value": source_of(value)} | _meaning(value, cls)
            if fields["kind"] != "value":
                fields["value"] = None
        if isinstance(target, ast.Name):
            if not owner:
                self.lists[target.id] = None if value is None else _strings(value, self.lists)
                if target.id == "__all__":
                    fields["all_names"] = self.lists[target.id]
            self.add(owner, cls, target.id, node, fallback, **fields)
        elif isinstance(target, ast.Attribute) and (up := _dotted(target.value, cls)) is not None:
            self.add(f"{owner}.{up}" if owner else up, None, _mangled(target.attr, cls), node, fallback,
                     **fields | {"attached": True})

    def augment(self, node, owner, cls, fallback):
        if isinstance(node.target, ast.Name):
            name, fields = node.target.id, {"kind": "value"}
            if not owner:
                old, more = self.lists.get(name), _strings(node.value, self.lists)
                new = None if old is None or more is None or not isinstance(node.op, ast.Add) else old + more
                self.lists[name] = new
                fields |= {"all_names": new} if name == "__all__" else {}
            self.add(owner, cls, name, node, fallback, **fields)

    def changed_list(self, node, owner, cls, fallback):
        """`__all__.extend([...])`, `.append` and `.remove`, and the like for other top-level lists."""
        call = node.value
        if owner or not isinstance(call, ast.Call) or not isinstance(call.func, ast.Attribute) or len(call.args) != 1:
            return
        name, how = _dotted(call.func.value, cls), call.func.attr
        if how not in ("extend", "append", "remove") or self.lists.get(name) is None:
            return
        arg = call.args[0] if how == "extend" else ast.List([call.args[0]])
        old, more = self.lists[name], _strings(arg, self.lists)
        if more is None:
            new = None
        elif how == "remove":
            new = [n for i, n in enumerate(old) if n not in more or n in old[:i]]
        else:
            new = old + more
        self.lists[name] = new
        if name == "__all__":
            self.add(owner, cls, name, node, fallback, kind="value", all_names=new)

    def walrus(self, node, owner, cls, fallback):
        """Names bound inside an expression, outside of functions within it."""
        todo = [node] if node is not None else []
        while todo:
            at = todo.pop()
            if isinstance(at, (ast.Constant, ast.Name, ast.expr_context)):
                continue
            if isinstance(at, ast.NamedExpr):
                self.assign(at.target, at.value, at, owner, cls, fallback)
            if not isinstance(at, ast.Lambda):
                todo += ast.iter_child_nodes(at)


def _module_rows(modname, path, source):
    found = _Bindings(modname, path)
    head = found.base | {"name": modname, "pos": -1}
    try:
        tree = ast.parse(source)
        found.body(tree.body)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as exc:
        return [head | {"kind": "error", "value": f"{type(exc).__name__}: {exc}"}]
    head |= {"kind": "module", "line_start": 0, "line_end": len(source.splitlines()),
             "doc": ast.get_docstring(tree, clean=False)}
    return [head, *found.rows]


def _parse(batches):
    schema = to_arrow_schema(RAW)
    # Trees have no cycles, and looking for some while they grow took a quarter of the time;
    # what else leaves cycles is collected after some batches.
    gc.disable()
    try:
        for i, batch in enumerate(batches, 1):
            rows, chars = [], 0
            # One source at a time: only its own tree is in memory.
            for source in zip(*(batch.column(name) for name in ("modname", "path", "source"))):
                rows += _module_rows(*(value.as_py() for value in source))
                chars += len(source[-1].as_py() or "")
                if len(rows) >= ROWS_PER_BATCH or chars >= CHARS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
            if i % 20 == 0:
                gc.collect()
    finally:
        gc.enable()


def parse_sources(sources: DataFrame) -> DataFrame:
    """Raw rows of every source (modname, path, source), one per binding."""
    sources.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SOURCES_PER_BATCH)
    return sources.select("modname", "path", "source").mapInArrow(_parse, RAW)


def split_errors(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, sources that do not parse): a bad source never stops the run."""
    failed = raw.filter(col("kind") == "error").select(
        "modname", "path", col("value").alias("problem"))
    return raw.filter(col("kind") != "error"), failed


def bindings(raw: DataFrame) -> DataFrame:
    """What each name of a module or class is bound to in the end: one row a name.

    The last statement counts, one in an exception handler only if there is no other, and a
    deleted name is gone. A property and its accessors are one row with has_get, has_set
    and has_del. A name set on something else (`X.y = ...`) counts where X is a class or
    function of the module. One aggregate that combines before the shuffle.
    """
    if "has_get" in raw.columns:
        return raw
    rows = raw.filter((col("kind") != "error") & ~F.coalesce(col("qualname").endswith("*"), F.lit(False)))
    accessor = col("kind").isin(*ACCESSORS)
    rank = F.struct(~col("fallback"), "pos")
    row = F.struct(*[c for c in raw.columns if c not in ("modname", "qualname")])
    last = rows.groupBy("modname", "qualname").agg(
        F.max_by(row, F.when(~accessor, rank)).alias("b"), F.min_by(row, F.when(accessor, rank)).alias("a"),
        *[F.max(F.when(col("kind") == kind, col("pos"))).alias(f"{role}_at") for kind, role in ROLE_BY_ACCESSOR.items()])
    # An accessor after the last plain binding changes it if that is a property.
    after = F.greatest("get_at", "set_at", "del_at") > F.coalesce(col("b.pos"), F.lit(-1))
    own = col("b.kind").isNotNull() & ~(F.coalesce(after, F.lit(False)) & (col("b.kind") != "property"))

    def has(role):
        given = F.exists(F.coalesce("b.uses", F.array().cast(raw.schema["uses"].dataType)), lambda u: u["role"] == role)
        decorated = (col("b.signature").isNotNull() if role == "get" else F.lit(False))
        late = F.coalesce(col(f"{role}_at") > F.coalesce(col("b.pos"), F.lit(-1)), F.lit(False))
        return F.when(col("kind") == "property", late | ((col("b.kind") == "property") & (given | decorated))).alias(f"has_{role}")

    bound = last.withColumn("kind", F.when(own, col("b.kind")).otherwise("property")).select(
        "modname", "qualname", "kind",
        *[F.when(own, col(f"b.{c}")).otherwise(col(f"a.{c}")).alias(c) for c in raw.columns
          if c not in ("modname", "qualname", "kind")],
        *[has(role).alias(f"has_{role}") for role in ROLE_BY_ACCESSOR.values()],
    ).filter("kind <> 'delete'").select(*raw.columns, "has_get", "has_set", "has_del")
    # The holders would otherwise be worked out by the whole aggregate once more.
    bound = written(bound)
    holders = bound.filter(col("kind").isin("type", "function")).select("modname", col("qualname").alias("owner"))
    return bound.filter("NOT attached").unionByName(
        bound.filter("attached").join(holders, ["modname", "owner"], "left_semi").select(*bound.columns))


# Accessor role by the kind of decorator.
ROLE_BY_ACCESSOR = {"getter": "get", "setter": "set", "deleter": "del"}


def objects(raw: DataFrame) -> DataFrame:
    """Object rows from raw rows, one for each name; imports become rows of `aliases` instead."""
    module = col("kind") == "module"
    callable_kinds = ("function", "type")
    return bindings(raw).filter(
        (col("kind") != "import") & ~F.coalesce(O.is_internal(N.last_part(col("qualname"))), F.lit(False))
    ).select(
        "modname", "qualname", "name",
        F.lit(N.BUILTINS).alias("type_mod"),
        F.when(col("kind") != "value", col("kind")).otherwise(col("value_type")).alias("type_name"),
        col("kind").isin(*callable_kinds).alias("callable"),
        F.when(~module, F.substr("value", F.lit(1), F.lit(O.MAX_REPR))).alias("repr"),
        col("path").alias("source_file"), "line_start", "line_end", "doc", "bases",
        "signature", "has_get", "has_set", "has_del", "owner", "uses")


def accessor_rows(raw: DataFrame) -> DataFrame:
    """One row per property accessor: modname, qualname, role."""
    roles = F.filter(F.array(*[F.when(col(f"has_{r}"), F.lit(r)) for r in ("get", "set", "del")]), lambda r: r.isNotNull())
    return bindings(raw).filter(col("kind") == "property").select("modname", "qualname", F.explode(roles).alias("role"))


def exports(raw: DataFrame) -> DataFrame:
    """`__all__` of every module that has one whose names can be told: modname, all_names."""
    return raw.filter((col("kind") == "value") & (col("qualname") == "__all__")).groupBy("modname").agg(
        F.max_by(F.struct("all_names"), F.struct(~col("fallback"), "pos")).alias("a")
    ).select("modname", "a.all_names").filter("all_names IS NOT NULL")


def _targets(raw: DataFrame, packages: DataFrame | None) -> DataFrame:
    """Import rows with `from_mod` (absolute) and `item`, NULL for a plain module import."""
    rows = raw.filter(col("kind") == "import")
    if packages is None:
        own = rows.withColumn("_is_package", F.lit(False))
    else:
        known = packages.select("modname").distinct().withColumn("_is_package", F.lit(True))
        own = rows.join(known, "modname", "left").withColumn(
            "_is_package", F.coalesce("_is_package", F.lit(False)))
    pieces = N.parts(col("modname"))
    keep = F.size(pieces) - col("level") + F.when(col("_is_package"), 1).otherwise(0)
    base = F.array_join(F.slice(pieces, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    named = F.substring_index("target", ":", 1)
    absolute = F.when(
        col("level") > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(named, F.lit("")))
    ).otherwise(named)
    is_from = col("target").contains(":")
    return own.select(
        "modname", col("qualname").alias("member_name"), absolute.alias("from_mod"),
        F.when(is_from, F.regexp_replace("target", r"^[^:]*:", "")).alias("item"))


def aliases(raw: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Import edges: modname, member_name, target_mod, target_qual (NULL for a module).

    Relative imports are taken from the module's own package. `packages` (modname)
    tells which modules are packages themselves. See `star_aliases` for `*`.
    """
    return _targets(bindings(raw), packages).filter("item IS NULL OR item <> '*'").select(
        "modname", "member_name", col("from_mod").alias("target_mod"),
        col("item").alias("target_qual"))


def star_aliases(raw: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Import edges of `from module import *`: one per public top-level name of the module.

    A module with `__all__` gives the names in it, another one its names without a
    leading underscore; names it imports itself count too.
    """
    stars = _targets(raw, packages).filter("item = '*'").select(
        "modname", col("from_mod").alias("target_mod")).distinct()
    # Only names of modules that a star stands for travel.
    own = raw.filter(
        ~col("kind").isin("module", "error", "delete") & col("qualname").isNotNull()
        & ~col("qualname").contains(".") & (col("qualname") != "*")
    ).select(col("modname").alias("target_mod"), col("qualname").alias("target_qual")).join(
        stars.select("target_mod").distinct(), "target_mod", "left_semi").distinct()
    listed = exports(raw).withColumnRenamed("modname", "target_mod")
    public = own.join(listed, "target_mod", "left").filter(F.coalesce(
        F.array_contains("all_names", col("target_qual")), ~col("target_qual").startswith("_")))
    return stars.join(public, "target_mod").select(
        "modname", col("target_qual").alias("member_name"), "target_mod", "target_qual")


def settle_module_targets(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Turn `package:name` targets into the module `package.name` where that module exists."""
    known = modules.select(col("modname").alias("_sub")).distinct()
    joined = edges.withColumn("_full", N.full_name(col("target_mod"), col("target_qual"))).join(
        known, (col("_full") == col("_sub")) & col("target_qual").isNotNull(), "left")
    is_module = col("_sub").isNotNull()
    return joined.select(
        "modname", "member_name",
        F.when(is_module, col("_full")).otherwise(col("target_mod")).alias("target_mod"),
        F.when(~is_module, col("target_qual")).alias("target_qual"))


def params(raw: DataFrame) -> DataFrame:
    """Parameter rows of every function: modname, qualname, pos, name, kind, ..."""
    return explode_rows(
        bindings(raw), ["modname", "qualname"], col("signature.params"), "p", pos="_at"
    ).select("modname", "qualname", "p.*")
