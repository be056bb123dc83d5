"""Source files and the module names they make up."""

from __future__ import annotations

import os
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import durable

col = F.col

_LISTED = "root string, path string, is_dir boolean, size bigint, mtime double"


def _list_folders(batches):
    """Entries of each folder (root, path); unreadable folders give none."""
    columns = ["root", "path", "is_dir", "size", "mtime"]
    for batch in batches:
        for root, folder in zip(batch["root"], batch["path"]):
            found = []
            try:
                with os.scandir(os.path.join(root, folder) if folder else root) as entries:
                    for entry in entries:
                        path = f"{folder}/{entry.name}" if folder else entry.name
                        is_dir = entry.is_dir()
                        if is_dir or entry.name.endswith(".py"):
                            info = entry.stat()
                            found.append((root, path, is_dir, info.st_size, info.st_mtime))
            except OSError:
                continue
            if found:
                yield pd.DataFrame(found, columns=columns)


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All `.py` files under the roots: root, path, size, mtime.

    Spark's own file sources skip names that start with an underscore, so the
    folders are listed in tasks, one tree level a round; the folders of a level are
    spread over the cluster, whatever root they belong to.
    """
    level = spark.createDataFrame([(r, "") for r in roots], "root string, path string")
    folders, most = len(roots), int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = []
    while True:
        tasks = max(1, min(most, folders))
        listed = durable(
            level.repartition(tasks, "root", "path").mapInPandas(_list_folders, _LISTED))
        files.append(listed.filter("NOT is_dir").drop("is_dir"))
        level = listed.filter("is_dir").select("root", "path")
        folders = level.count()
        if not folders:
            break
    every = files[0]
    for part in files[1:]:
        every = every.unionByName(part)
    return every


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def _dotted(path: Column) -> Column:
    """Relative path to dotted name, without the last suffix."""
    return F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", ""), F.lit("/"), F.lit("."))


def packages(files: DataFrame) -> DataFrame:
    """Folders that are packages all the way down from their root: root, folder.

    Only distinct folders are exploded into their parents, not files.
    """
    starts = files.filter(col("path").rlike(r"(^|/)__init__\.py\z")).select(
        "root", _folder(col("path")).alias("folder")).filter("folder <> ''").distinct()
    pieces = F.split("folder", "/")
    chain = F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))
    steps = starts.select("root", "folder", F.size(pieces).alias("depth"), F.explode(chain).alias("step"))
    kept = steps.join(starts.withColumnRenamed("folder", "step"), ["root", "step"])
    return kept.groupBy("root", "folder", "depth").agg(F.count("*").alias("n")).filter(
        "n = depth").select("root", "folder")


def modules(files: DataFrame) -> DataFrame:
    """Importable modules of every root: root, modname, path, is_package.

    A file counts when every folder down to it is a package; a package counts
    itself. A root's own `__init__.py` gives nothing.
    """
    good = packages(files)
    inits = good.select(
        "root", _dotted(col("folder")).alias("modname"),
        F.concat("folder", F.lit("/__init__.py")).alias("path"), F.lit(True).alias("is_package"))
    plain = files.filter(
        col("path").endswith(".py") & ~col("path").rlike(r"(^|/)__init__\.py\z")
    ).withColumn("folder", _folder(col("path")))
    top = plain.filter("folder = ''")
    inner = plain.filter("folder <> ''").join(good, ["root", "folder"], "left_semi")
    leaf = [
        "root", _dotted(col("path")).alias("modname"), "path", F.lit(False).alias("is_package")]
    return inits.unionByName(top.select(*leaf)).unionByName(inner.select(*leaf))


def modules_under(files: DataFrame, package: str) -> DataFrame:
    """Modules of one top-level package or module file of a root."""
    return submodules(modules(files), package)


def submodules(names: DataFrame, modname: str) -> DataFrame:
    """A module and everything below it, by name."""
    own = col("modname")
    return names.filter((own == modname) | own.startswith(modname + "."))


def standard_modules(names: DataFrame) -> DataFrame:
    """Names without `test` anywhere in them."""
    return names.filter(~col("modname").contains("test"))


def usable_roots(rows: DataFrame, install_prefix: str) -> DataFrame:
    """Rows whose root does not start with the install prefix, compared as text."""
    return rows.filter(~col("root").startswith(install_prefix))


def modules_in_path(spark: SparkSession, roots: list[str], install_prefix: str) -> DataFrame:
    """Modules of several roots; roots under the prefix are skipped, duplicates kept."""
    times = Counter(r for r in roots if not r.startswith(install_prefix))
    found = modules(list_files(spark, list(times)))
    # A root named twice is listed twice.
    for root, n in times.items():
        if n > 1:
            copies = F.when(col("root") == root, F.lit(n)).otherwise(F.lit(1))
            found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    return found


def _read_sources(batches):
    for batch in batches:
        for row in batch.itertuples(index=False):
            try:
                with open(os.path.join(row.root, row.path), encoding="utf-8") as file:
                    text, problem = file.read(), None
            except (OSError, UnicodeDecodeError) as exc:
                text, problem = None, f"{type(exc).__name__}: {exc}"
            yield pd.DataFrame(
                [(row.root, row.modname, row.path, text, problem)],
                columns=["root", "modname", "path", "source", "problem"])


def read_sources(names: DataFrame) -> DataFrame:
    """Source text of every module, read where the tasks run: one row a file."""
    return names.select("root", "modname", "path").mapInPandas(
        _read_sources, "root string, modname string, path string, source string, problem string")
