"""The module cache: fingerprinted object rows in generations, looked up in tiers, refreshed by difference.

An entry is good when version, path, mtime and size all equal the scan's. A cache folder holds

* `entries/run=.../bucket=...`: object rows, written once and never changed,
* `index/generation=n`: which run holds a module from generation n on, with its fingerprint,
* `commits/generation=n`: one row in one file, written last.

A generation exists once its commit does, so readers see the old state until then, and what a
killed run has left is written over by the next one. Only changed modules are written;
`compact` starts a new base, behind which nothing older is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.session import durable
from docloom.sources import extract, inventory

col = F.col

# Fixed value: version of the stored rows.
VERSION = 1

PRINT = ("version", "path", "mtime", "size")
BUCKETS = 256

INDEX = "modname string, version int, path string, mtime double, size bigint, run string, generation bigint"
COMMIT = "base bigint, generation bigint"


def fresh(entries: DataFrame, scan: DataFrame, key: str = "modname") -> DataFrame:
    """Entries whose fingerprint equals the scan's; a missing path never does."""
    return entries.join(scan.select(key, *PRINT), [key, *PRINT], "left_semi")


def stale(entries: DataFrame, scan: DataFrame, key: str = "modname") -> DataFrame:
    return entries.join(scan.select(key, *PRINT), [key, *PRINT], "left_anti")


def evict(entries: DataFrame, scan: DataFrame, key: str = "modname") -> DataFrame:
    """What is left after stale entries are dropped; modules not scanned are kept."""
    # One join: a scan has one row a module, so no entry is repeated.
    now = scan.select(col(key).alias("_key"), *[col(c).alias(f"_{c}") for c in PRINT])
    same = reduce(lambda a, b: a & b, [col(c) == col(f"_{c}") for c in PRINT])
    return (entries.join(now, col(key) == col("_key"), "left")
            .filter(col("_key").isNull() | F.coalesce(same, F.lit(False))).select(*entries.columns))


def tiered_lookup(scan: DataFrame, tiers: list[DataFrame], key: str = "modname") -> DataFrame:
    """The scan with `tier`: number of the first tier holding a fresh entry, 0 for recompute."""
    tagged = [
        t.select(key, *PRINT).withColumn("tier", F.lit(i).cast("bigint"))
        for i, t in enumerate(tiers, 1)]
    best = reduce(DataFrame.unionByName, tagged).groupBy(key, *PRINT).agg(F.min("tier").alias("tier"))
    return scan.join(best, [key, *PRINT], "left").withColumn("tier", F.coalesce("tier", F.lit(0)))


def cacheable(path: Column, install_prefix: Column, first_tier: bool) -> Column:
    """Whether a module may be stored: it has a file, and in tier one not an installed one."""
    has_file = path.isNotNull()
    if not first_tier:
        return has_file
    return has_file & ~N.is_subpath(path, install_prefix)


def bucket_of(modname: Column) -> Column:
    return F.pmod(F.xxhash64(modname), F.lit(BUCKETS)).cast("int")


# -- generations ------------------------------------------------------------


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """A table of the cache, or None before its first commit."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(generation, base) of the last commit; (0, 1) where there is none."""
    commits = _read(spark, f"{folder}/commits", COMMIT)
    row = None if commits is None else commits.agg(F.max(F.struct("generation", "base")).alias("c")).first().c
    return (0, 1) if row is None else (row.generation, row.base)


def index(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """The run and fingerprint of every module as of a committed generation (the last one).

    One row a module: the newest entry since the base, found by an aggregate that combines
    before the shuffle.
    """
    if generation is None:
        generation, base = latest(spark, folder)
    else:
        commits = _read(spark, f"{folder}/commits", COMMIT)
        base = commits.filter(col("generation") == generation).first().base
    rows = _read(spark, f"{folder}/index", INDEX) if generation else None
    if rows is None:
        return spark.createDataFrame([], INDEX)
    return rows.filter(col("generation").between(base, generation) & col("modname").isNotNull()).groupBy("modname").agg(
        F.max_by(F.struct(*PRINT, "run", "generation"), "generation").alias("i")).select("modname", "i.*")


def commit(spark: SparkSession, folder: str, entries: DataFrame, prints: DataFrame, run: str, full: bool = False) -> int:
    """Store the entries (modname, payload, ...) of the modules in `prints` (modname and fingerprint) as a
    new generation, and return its number. With `full`, no older generation counts any more.

    A module without entries is stored too, as one that has none.
    """
    last, base = latest(spark, folder)
    number = last + 1
    name = f"{run}-{number}"
    entries.withColumn("bucket", bucket_of(col("modname"))).repartition("bucket").write.partitionBy("bucket").mode(
        "overwrite").parquet(f"{folder}/entries/run={name}")
    # A row without module marks a generation that changes nothing.
    mark = spark.createDataFrame([(None,) * 6], INDEX.rsplit(",", 1)[0])
    prints.select("modname", *PRINT, F.lit(name).alias("run")).unionByName(mark).write.mode("overwrite").parquet(
        f"{folder}/index/generation={number}")
    spark.createDataFrame([(number if full else base,)], "base bigint").coalesce(1).write.mode("errorifexists").parquet(
        f"{folder}/commits/generation={number}")
    return number


def load(spark: SparkSession, folder: str, modname: str | None = None, generation: int | None = None) -> DataFrame:
    """The entries of one generation, each module from its newest run; or one module's, reading its bucket only."""
    current = index(spark, folder, generation).select("modname", "run")
    if modname is not None:
        current = current.filter(col("modname") == modname)
    # Runs since the base: their number does not grow with the data, and only their folders are listed.
    runs = [r.run for r in current.select("run").distinct().collect()]
    if not runs:
        raise LookupError(f"nothing stored in {folder}" if modname is None else f"{modname} is not in {folder}")
    entries = spark.read.option("basePath", f"{folder}/entries").parquet(*[f"{folder}/entries/run={r}" for r in runs])
    if modname is not None:
        return entries.filter((col("bucket") == bucket_of(F.lit(modname))) & (col("modname") == modname))
    return entries.join(current, ["modname", "run"], "left_semi")


def compact(spark: SparkSession, folder: str, scan: DataFrame) -> int:
    """One new run, and a new base, of all modules that survive eviction; returns the generation."""
    current = durable(evict(index(spark, folder), scan))
    kept = load(spark, folder).join(current.select("modname", "run"), ["modname", "run"], "left_semi")
    return commit(spark, folder, kept.drop("run", "bucket"), current, "compact", full=True)


# -- filling ------------------------------------------------------------------


def fingerprints(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Scan rows of discovered modules: modname, root, and the fingerprint."""
    return modules.join(files.select("root", "path", "mtime", "size"), ["root", "path"]).select(
        "modname", "root", F.lit(VERSION).alias("version"), "path", "mtime", "size")


def entries_of(sources: DataFrame) -> DataFrame:
    """Cache entries of sources: one row per raw row of a module, its fields as JSON."""
    good, _ = extract.split_errors(extract.parse_sources(sources))
    return good.select("modname", "path", F.to_json(F.struct(*[
        c for c in good.columns if c not in ("modname", "path")])).alias("payload"))


def refresh_sources(spark: SparkSession, snapshots: DataFrame, folder: str, run: str) -> DataFrame:
    """Extract and store the snapshots (modname, fingerprint, source) that have no fresh entry.

    Returns their fingerprints. Where all are fresh, no generation is made.
    """
    todo = durable(stale(snapshots, index(spark, folder)))
    if not todo.isEmpty():
        commit(spark, folder, entries_of(todo), todo, run)
    return todo.select("modname", *PRINT)


def refresh(spark: SparkSession, roots: list[str], packages: list[str], folder: str,
            run: str) -> DataFrame:
    """Bulk precompute: modules of the packages and below that have no fresh entry.

    Returns the scan rows that were recomputed.
    """
    files = inventory.list_files(spark, roots)
    names = inventory.modules(files)
    wanted = reduce(
        DataFrame.unionByName, [inventory.submodules(names, p) for p in packages]).distinct()
    todo = stale(fingerprints(files, wanted), index(spark, folder))
    sources = inventory.read_sources(todo).filter("problem IS NULL").join(
        todo.select("root", "modname", *PRINT), ["root", "modname", "path"])
    return refresh_sources(spark, sources, folder, run)
