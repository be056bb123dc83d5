"""Member listings: visibility, categories, marks, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import objects as O

col = F.col


def visible(members: DataFrame, parents: DataFrame, private: bool = False,
            imports: bool = True, strict: bool = False) -> DataFrame:
    """Members listed for their parents.

    `members`: parent_mod, parent_qual, member_name, is_ref, ...; `parents`:
    modname, qualname, type_name, has_all_names, all_names. Import filtering needs
    no join, so it runs in the scan's stage.
    """
    kept = members if imports else members.filter(~col("is_ref"))
    if private:
        return kept
    right = parents.select(
        col("modname").alias("_m"), col("qualname").alias("_q"),
        col("type_name").alias("_type"), "has_all_names", "all_names")
    joined = kept.join(
        right, (col("parent_mod") == col("_m")) & col("parent_qual").eqNullSafe(col("_q")))
    shown = O.is_visible(
        col("member_name"), col("_type"), col("has_all_names"), col("all_names"), strict=strict)
    return joined.filter(shown).drop("_m", "_q", "_type", "has_all_names", "all_names")


def listing(members: DataFrame, imports: bool = True) -> DataFrame:
    """Members in display order. The sort key includes the name, so a huge parent
    is spread over many range partitions."""
    kept = members if imports else members.filter(~col("is_ref"))
    return kept.orderBy("parent_mod", "parent_qual", "member_name")


def split_by(df: DataFrame, predicate) -> tuple[DataFrame, DataFrame]:
    """(rows where the predicate is not true, rows where it is)."""
    true = F.coalesce(predicate, F.lit(False))
    return df.filter(~true), df.filter(true)


def by_category(members: DataFrame, *keys: str) -> DataFrame:
    """Counts of members and refs per category."""
    return members.groupBy(*keys, "category").agg(
        F.count("*").alias("n"), F.count_if("is_ref").alias("n_ref"))


def attach_types(objects: DataFrame, types: DataFrame, payload: list[str]) -> DataFrame:
    """Each object with columns of its type's row, prefixed `type_row_`."""
    right = types.select(
        col("modname").alias("_m"), col("qualname").alias("_q"),
        *[col(c).alias(f"type_row_{c}") for c in payload])
    return objects.join(
        right, (col("type_mod") == col("_m")) & (col("type_qual") == col("_q")), "left"
    ).drop("_m", "_q")


def attach_func(objects: DataFrame, payload: list[str]) -> DataFrame:
    """Wrappers with columns of the function they wrap (rows of role `func`)."""
    own = objects.filter(col("role") == "self")
    func = objects.filter(col("role") == "func").select(
        col("modname").alias("_m"), col("qualname").alias("_q"), F.lit(True).alias("has_func"),
        *[col(c).alias(f"func_{c}") for c in payload])
    return own.join(
        func, (col("modname") == col("_m")) & col("qualname").eqNullSafe(col("_q")), "left"
    ).drop("_m", "_q")


def attach_innermost(objects: DataFrame, payload: list[str]) -> DataFrame:
    """Objects with columns of the innermost function that they wrap, through wrappers of any
    number (`inner_...`), and `wraps`, how many there are. A role names the whole way inward,
    so the longest one is the innermost: one aggregate for all depths."""
    own = objects.filter(col("role") == "self")
    depth = F.size(F.split("role", r"\."))
    inner = objects.filter(col("role").rlike(r"^func(\.func)*$")).groupBy(
        col("modname").alias("_m"), col("qualname").alias("_q")
    ).agg(F.max(depth).cast("bigint").alias("wraps"), F.max_by(F.struct(*payload), depth).alias("_in"))
    return own.join(
        inner, (col("modname") == col("_m")) & col("qualname").eqNullSafe(col("_q")), "left"
    ).select(*own.columns, F.coalesce("wraps", F.lit(0)).alias("wraps"),
             *[col(f"_in.{c}").alias(f"inner_{c}") for c in payload])


def accessors(objects: DataFrame) -> DataFrame:
    """One row per property and accessor word; `present` tells whether it exists."""
    words = F.array(*[F.lit(w) for w in ("get", "set", "del")])
    wanted = objects.filter(
        (col("role") == "self") & (col("type_name") == "property")
    ).select("modname", "qualname", F.posexplode(words).alias("pos", "accessor"))
    have = objects.filter(col("role").isin("get", "set", "del")).select(
        "modname", "qualname", col("role").alias("accessor"), F.lit(True).alias("present"))
    joined = wanted.join(have, ["modname", "qualname", "accessor"], "left")
    return joined.withColumn("present", F.coalesce("present", F.lit(False))).withColumn(
        "pos", col("pos").cast("bigint"))
