"""Documentation sets: nested JSON to flat tables and back.

A documentation set is `{"modules": {name: object}}`; an object may hold further
objects under `dict`, and anywhere an object may stand a `{"$ref": ...}` may stand
instead. Every field is optional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.functions import objects as O
from docloom.functions.generate import explode_rows
from docloom.operators.sequence import Ordered
from docloom.session import durable

col = F.col

NESTED = ("func", "get", "set", "del")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its JSON text. Compressed files are read as they are."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def _get(node: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(col(node) if isinstance(node, str) else node, path, kind)


def _has(node: str, key: str) -> Column:
    """Whether the key is there at all; a JSON null counts."""
    return F.try_variant_get(col(node), f"$.{key}", "variant").isNotNull()


def _entries(df: DataFrame, keep: list, entries: Column, name: str) -> DataFrame:
    """One row per map entry: its key as `name`, its value as `node`, computed once."""
    return df.select(*keep, F.explode_outer(entries).alias(name, "node")).filter(
        col(name).isNotNull())


def bad_documents(documents: DataFrame) -> DataFrame:
    """The documents that are not JSON; `flatten` passes them over."""
    return documents.filter(col("json").isNotNull() & F.try_parse_json("json").isNull())


def flatten(documents: DataFrame) -> DataFrame:
    """All objects and refs of documents (column `json`), one row each.

    Columns: modname, qualname, parent_qual, name, role, is_ref, ref, node. `role` is
    `self`, or tells how the object is wrapped: func, get, set or del for the function
    inside a wrapper or property, `func.func` for the one inside that, and so on.
    One frontier moves over both kinds of edges, entries of `dict` and inner functions,
    until it is empty. A ref is a leaf, so a loop made of refs is never followed.
    """
    none = F.lit(None).cast("string")
    modules = _entries(
        documents, [], _get(F.try_parse_json("json"), "$.modules", "map<string,variant>"), "modname")
    level = durable(modules.select(
        "modname", none.alias("qualname"), none.alias("parent_qual"), col("modname").alias("name"),
        F.lit("self").alias("role"), _get("node", "$['$ref']").alias("ref"), "node"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level = durable(_below(level.filter("ref IS NULL")))
    every = levels[0] if levels else level
    for part in levels[1:]:
        every = every.unionByName(part)
    return every.select(
        "modname", "qualname", "parent_qual", "name", "role", N.is_ref(col("ref")).alias("is_ref"), "ref", "node")


def _below(level: DataFrame) -> DataFrame:
    """The objects right inside those of a level: members, then wrapped functions and accessors."""
    def entry(key: str | None, name: Column, node: Column) -> Column:
        return F.struct(F.lit(key).cast("string").alias("key"), name.alias("name"), node.alias("node"))

    # A member that is a JSON null counts; a missing accessor is written as one and does not.
    own = F.transform(
        F.map_entries(_get("node", "$.dict", "map<string,variant>")),
        lambda e: entry(None, e["key"], e["value"]))
    inner = F.filter(
        F.array(*[entry(k, col("name"), _get("node", f"$.{k}", "variant")) for k in NESTED]),
        lambda e: e["node"].isNotNull() & ~F.is_variant_null(e["node"]))
    none = F.array().cast("array<struct<key:string,name:string,node:variant>>")
    rows = explode_rows(
        level, ["modname", "qualname", "parent_qual", "role"], F.concat(F.coalesce(own, none), inner), "e")
    member, role = col("e.key").isNull(), F.when(col("role") != "self", col("role"))
    return rows.select(
        "modname",
        F.when(member, N.child(col("qualname"), col("e.name"))).otherwise(col("qualname")).alias("qualname"),
        F.when(member, col("qualname")).otherwise(col("parent_qual")).alias("parent_qual"),
        col("e.name").alias("name"),
        F.when(member, F.lit("self")).otherwise(F.concat_ws(".", role, "e.key")).alias("role"),
        _get("e.node", "$['$ref']").alias("ref"), col("e.node").alias("node"))


def objects(nodes: DataFrame) -> DataFrame:
    """Columns of the documented objects among the flattened nodes."""
    kind = N.parse_ref(_get("node", "$.type['$ref']"))
    return nodes.filter("NOT is_ref").select(
        "modname", "qualname", "role",
        F.coalesce(_get("node", "$.name"), col("name")).alias("name"),
        kind["modname"].alias("type_mod"), kind["qualname"].alias("type_qual"),
        _get("node", "$.type_name").alias("type_name"),
        O.stored_repr(_get("node", "$.repr"), F.lit(False)).alias("repr"),
        _get("node", "$.callable", "boolean").alias("callable"),
        _has("node", "all_names").alias("has_all_names"),
        _get("node", "$.all_names", "array<string>").alias("all_names"),
        _get("node", "$.source.source_file").alias("source_file"),
        _get("node", "$.source.file").alias("file"),
        _get("node", "$.source.lines[0]", "bigint").alias("line_start"),
        _get("node", "$.source.lines[1]", "bigint").alias("line_end"),
        _get("node", "$.docs.doc").alias("doc"),
        _get("node", "$.docs.summary").alias("summary"),
    )


def members(nodes: DataFrame) -> DataFrame:
    """Edges from parents to their members, own objects and refs alike."""
    target = N.parse_ref(col("ref"))
    place = F.struct(col("modname").alias("modname"), col("qualname").alias("qualname"))
    to = F.when(col("is_ref"), target).otherwise(place)
    return nodes.filter("role = 'self' AND qualname IS NOT NULL").select(
        col("modname").alias("parent_mod"), "parent_qual", col("name").alias("member_name"),
        "is_ref", to["modname"].alias("target_mod"), to["qualname"].alias("target_qual"),
        _get("node", "$.exported", "boolean").alias("exported"))


def params(nodes: DataFrame) -> DataFrame:
    """Parameter rows of every signature; a default or annotation shows its ref target or repr."""
    def shown(key):
        ref = N.parse_ref(_get("p", f"$.{key}['$ref']"))
        named = N.context_name(ref["modname"], ref["qualname"])
        return F.when(ref.isNotNull(), named).otherwise(_get("p", f"$.{key}.repr"))

    rows = explode_rows(
        nodes.filter("NOT is_ref"), ["modname", "qualname", "role"],
        _get("node", "$.signature.params", "array<variant>"), "p")
    return rows.select(
        "modname", "qualname", "role", (col("pos") + 1).alias("pos"),
        _get("p", "$.name").alias("name"), _get("p", "$.kind").alias("kind"),
        shown("default").alias("default_repr"), shown("annotation").alias("annotation"),
        _get("p", "$.doc").alias("doc"), _get("p", "$.doc_type").alias("doc_type"))


def ref_edges(nodes: DataFrame, key: str) -> DataFrame:
    """Ordered `bases` or `mro` refs of every type, ready for `base_edges`."""
    refs = F.transform(
        _get("node", f"$.{key}", "array<variant>"), lambda v: _get(v, "$['$ref']"))
    return nodes.filter("NOT is_ref").select("modname", "qualname", refs.alias(key))


# -- writing --------------------------------------------------------------


def object_json(*fields: str | Column) -> Column:
    """JSON text of one object's fields; absent fields are left out."""
    return F.to_json(F.struct(*fields))


def docset_lines(rows: DataFrame) -> DataFrame:
    """Text lines whose concatenation, in order of `pos`, is one documentation set.

    Input: modname, qualname, fields (JSON object text). Every member's parent must
    be there. Rows are put in tree order by name parts; each one writes its own
    fields and closes as many levels as the next row leaves, so no module is ever
    gathered in one place.
    """
    ordered = Ordered(_placed(rows), (), ["modname", "_parts"])
    near = ordered.neighbours({"_next": ("_depth", 1)})
    return near.select("pos", _line(col("pos") == 0).alias("line"))


def _placed(rows: DataFrame) -> DataFrame:
    parts = F.coalesce(N.parts(col("qualname")), F.array().cast("array<string>"))
    return rows.withColumn("_parts", parts).withColumn("_depth", F.size("_parts"))


def _line(first: Column) -> Column:
    """Text of one row, given `_next`, the depth of the row after it in the same set."""
    key = F.to_json(F.array(F.coalesce(F.try_element_at("_parts", F.lit(-1)), "modname")))
    name = F.substr(key, F.lit(2), F.length(key) - 2)
    inner = F.substr("fields", F.lit(2), F.length("fields") - 2)
    child = F.coalesce(col("_next") > col("_depth"), F.lit(False))
    up = F.coalesce(col("_depth") - col("_next"), col("_depth"))
    comma = F.when(col("_next").isNotNull(), ",").otherwise("}}")
    opening = F.concat(F.when(first, '{"modules": {').otherwise(""), name, F.lit(": {"), inner)
    return F.when(
        child, F.concat(opening, F.when(inner != "", ", ").otherwise(""), F.lit('"dict": {'))
    ).otherwise(F.concat(opening, F.lit("}"), F.repeat(F.lit("}}"), up), comma))


def write_docset(rows: DataFrame, path: str) -> None:
    """Write one set: the lines in order; the part files in name order form the document."""
    docset_lines(rows).orderBy("pos").select("line").write.mode("errorifexists").text(path)


def set_numbers(rows: DataFrame, size: int) -> DataFrame:
    """(modname, set): modules in name order, cut where another `size` characters of fields begin.

    A module is never cut. Running sums are taken within ranges of modules; the sums of whole
    ranges, one row a range, are added to them.
    """
    modules = rows.groupBy("modname").agg(F.sum(F.length("fields") + F.lit(16)).alias("_size"))
    placed = durable(modules.repartitionByRange("modname").withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_range").agg(F.sum("_size").alias("_all")).select(
        "_range", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_range").orderBy("modname").rowsBetween(Window.unboundedPreceding, 0)
    # One row a range.
    return placed.join(F.broadcast(before), "_range").select(
        "modname", F.floor((col("_before") + F.sum("_size").over(here) - col("_size")) / size).alias("set"))


def sets_lines(rows: DataFrame, size: int) -> DataFrame:
    """Text lines of several sets of about `size` characters: set, pos, modname, line."""
    numbered = _placed(rows).join(set_numbers(rows, size), "modname")
    inside = Window.partitionBy("set").orderBy("modname", "_parts")
    return numbered.select(
        "*", F.lead("_depth").over(inside).alias("_next"), (F.row_number().over(inside) - 1).cast("bigint").alias("pos")
    ).select("set", "pos", "modname", _line(col("pos") == 0).alias("line"))


def write_docsets(rows: DataFrame, folder: str, size: int = 64 << 20) -> None:
    """Write sets of about `size` characters, each one a valid document in a folder of its own,
    and an index that tells the set of every module. A set is written by one task, line by line."""
    lines = durable(sets_lines(rows, size))
    (lines.repartition("set").sortWithinPartitions("set", "pos").select("set", "line")
     .write.partitionBy("set").mode("errorifexists").text(f"{folder}/sets"))
    lines.select("modname", "set").distinct().write.mode("errorifexists").parquet(f"{folder}/index")


def read_docsets(spark: SparkSession, folder: str, modname: str | None = None) -> DataFrame:
    """The documents of written sets (column `json`), or the one that holds a module: then only it is read."""
    if modname is None:
        return read_documents(spark, f"{folder}/sets").select("json")
    found = spark.read.parquet(f"{folder}/index").filter(col("modname") == modname).first()
    if found is None:
        raise LookupError(f"{modname} is in no set of {folder}")
    return read_documents(spark, f"{folder}/sets/set={found['set']}").select("json")
