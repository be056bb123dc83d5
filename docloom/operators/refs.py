"""Resolution of refs, alias chains, dotted names and inheritance as joins.

Objects are keyed by (modname, qualname), aliases by (modname, member_name), both
unique. Every step is an equi-join on such a key: the many rows that may point at
one key sit on the left side, which AQE splits when a key is hot; the right side
holds one row per key. Iterative jobs send only unfinished rows to the next round
and cut lineage with `written`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import names as N
from docloom.functions.generate import explode_rows
from docloom.session import written

col = F.col


def resolve_once(edges: DataFrame, objects: DataFrame, payload: list[str]) -> DataFrame:
    """One hop: each edge with the payload columns of its target; NULLs where it is missing."""
    right = objects.select(
        col("modname").alias("_m"), col("qualname").alias("_q"), F.lit(True).alias("found"), *payload
    )
    hit = (col("target_mod") == col("_m")) & col("target_qual").eqNullSafe(col("_q"))
    return (
        edges.join(right, hit, "left").drop("_m", "_q")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def resolve_aliases(aliases: DataFrame, with_path: bool = False) -> DataFrame:
    """Follow every alias until its target is not an alias.

    Input: modname, member_name, target_mod, target_qual. Output: modname,
    member_name, final_mod, final_qual, hops, is_cycle, and with `with_path` the
    names met on the way. See `resolve_refs`, which this is under another key name.
    """
    return resolve_refs(
        aliases.withColumnRenamed("member_name", "qualname"), with_path
    ).withColumnRenamed("qualname", "member_name")


def resolve_refs(refs: DataFrame, with_path: bool = False) -> DataFrame:
    """Follow refs that stand at any depth, in a module or in a class, to their ends.

    Input: modname, qualname (unique), target_mod, target_qual. A target may lie below
    another ref, as `m.A.f` does where `m.A` is a ref to `n.B`: the prefix that is a ref
    is then replaced by what it leads to, until no prefix is one. Output: modname,
    qualname, final_mod, final_qual, hops, is_cycle, and with `with_path` the names met.
    """
    keyed = refs.select("modname", "qualname", "target_mod", "target_qual")
    ends = _chain_ends(keyed, with_path)
    places = keyed.select(col("modname").alias("target_mod"), col("qualname").alias("_prefix"))
    below = explode_rows(
        keyed.filter(col("target_qual").contains(".")), ["target_mod", "target_qual"],
        N.ancestor_names(col("target_qual")), "_prefix"
    ).join(places, ["target_mod", "_prefix"], "left_semi")
    if not below.isEmpty():
        ends = _rewritten(written(ends), with_path)
    cyclic = col("is_cycle")
    return ends.select(
        "modname", "qualname", *[F.when(~cyclic, col(a)).alias(b) for a, b in (
            ("cur_mod", "final_mod"), ("cur_qual", "final_qual"), ("hops", "hops"))],
        "is_cycle", *([F.when(~cyclic, col("path")).alias("path")] if with_path else []))


def _rewritten(ends: DataFrame, with_path: bool) -> DataFrame:
    """Ends of exact chains, with targets below a ref rewritten until they are below none.

    Only such rows take part. A row moves on when the first ref on its name is settled, and
    waits while that one is not: each move uses up a part of the name, and names grow no
    longer than their ends. Among the rows that end at all, the one with the least way left
    can always move, so a round without a move leaves only cycles.
    """
    keys, extra = ["modname", "qualname"], ["path"] if with_path else []
    state = [*keys, "cur_mod", "cur_qual", "hops", "is_cycle", *extra]

    def meet(rows: DataFrame, settled: DataFrame, waiting: DataFrame) -> DataFrame:
        """Rows whose name is below a ref, with the first such ref (`_open`: not settled yet)."""
        table = settled.withColumn("open", F.lit(False)).unionByName(waiting.withColumn("open", F.lit(True)))
        step = table.select(*[col(c).alias(f"_{c}") for c in table.columns])
        tried = explode_rows(rows, state, N.prefix_names(col("cur_qual")), "_prefix", pos="_at")
        hit = (col("cur_mod") == col("_modname")) & (col("_prefix") == col("_qualname"))
        return tried.join(step, hit).groupBy(*keys).agg(F.min_by(
            F.struct(*[c for c in state if c not in keys], "_prefix", *step.columns), "_at").alias("s")
        ).select(*keys, "s.*")

    live, cyclic = ends.filter("NOT is_cycle"), ends.filter("is_cycle")
    # Exact chains are followed already, so these are below a ref, not at one.
    active = written(meet(live, ends, ends.limit(0)).select(*state))
    settled = written(live.join(active.select(*keys), keys, "left_anti").unionByName(cyclic))
    left = active.count()
    while left:
        met = written(meet(active, settled, active).withColumn("_rest", F.substr("cur_qual", F.length("_prefix") + 1)))
        moved = met.filter("NOT _open").select(
            *keys, col("_cur_mod").alias("cur_mod"),
            F.nullif(F.ltrim(F.concat(F.coalesce("_cur_qual", F.lit("")), "_rest"), F.lit(".")), F.lit("")).alias("cur_qual"),
            (col("hops") + col("_hops")).alias("hops"), col("_is_cycle").alias("is_cycle"),
            *([F.concat("path", F.transform("_path", lambda p: F.concat(p, "_rest"))).alias("path")] if with_path else []))
        ended = active.join(met.select(*keys), keys, "left_anti")
        waiting = met.filter("_open").select(*state)
        still = waiting.count()
        settled = written(settled.unionByName(ended).unionByName(moved.filter("is_cycle")))
        active = written(waiting.unionByName(moved.filter("NOT is_cycle")))
        if still == left:
            break
        left = active.count()
    return settled.unionByName(active.withColumn("is_cycle", F.lit(True)))


def _chain_ends(keyed: DataFrame, with_path: bool) -> DataFrame:
    """Where chains of refs end whose targets are exactly the place of the next ref.

    Chains of any length are resolved: each round doubles the distance covered, so a
    chain of L hops takes about log2(L) rounds. Among unfinished rows of a round, those
    with the shortest way left always finish, so a round that finishes none leaves only
    cycles.
    """
    keyed = keyed.withColumn("_step", F.concat_ws(".", "target_mod", "target_qual"))
    targets = keyed.select(
        col("target_mod").alias("modname"), col("target_qual").alias("qualname")
    ).distinct()
    # Only refs that are themselves targets take part in the rounds.
    inner = keyed.join(targets, ["modname", "qualname"], "left_semi")
    jump = written(inner.select(
        "modname", "qualname",
        col("target_mod").alias("cur_mod"), col("target_qual").alias("cur_qual"),
        F.lit(1).cast("bigint").alias("hops"), F.lit(False).alias("done"),
        *([F.array("_step").alias("path")] if with_path else []),
    ))

    finished: list[DataFrame] = []
    active, left = jump, jump.count()
    while left:
        known = active
        for part in finished:
            known = known.unionByName(part)
        ahead = known.select(*[col(c).alias(f"_{c}") for c in known.columns])
        moved = active.join(
            ahead,
            (col("cur_mod") == col("_modname")) & (col("cur_qual") == col("_qualname")),
            "left",
        )
        at_end = col("_modname").isNull()
        moved = written(moved.select(
            "modname", "qualname",
            F.when(at_end, col("cur_mod")).otherwise(col("_cur_mod")).alias("cur_mod"),
            F.when(at_end, col("cur_qual")).otherwise(col("_cur_qual")).alias("cur_qual"),
            F.when(at_end, col("hops")).otherwise(col("hops") + col("_hops")).alias("hops"),
            (at_end | col("_done")).alias("done"),
            *([F.when(at_end, col("path")).otherwise(F.concat("path", "_path")).alias("path")]
              if with_path else []),
        ))
        finished.append(moved.filter("done"))
        active = moved.filter("NOT done")
        before, left = left, active.count()
        if left == before:
            break

    ends = active.withColumn("cycle", F.lit(True))
    for part in finished:
        ends = ends.unionByName(part.withColumn("cycle", F.lit(False)))
    ends = ends.select(
        col("modname").alias("_m"), col("qualname").alias("_n"), "cur_mod", "cur_qual",
        col("hops").alias("_hops"), "cycle", *(["path"] if with_path else []),
    )
    joined = keyed.join(
        ends, (col("target_mod") == col("_m")) & (col("target_qual") == col("_n")), "left")
    onward, cyclic = col("_m").isNotNull(), F.coalesce("cycle", F.lit(False))
    return joined.select(
        "modname", "qualname",
        F.when(onward, col("cur_mod")).otherwise(col("target_mod")).alias("cur_mod"),
        F.when(onward, col("cur_qual")).otherwise(col("target_qual")).alias("cur_qual"),
        (F.lit(1) + F.coalesce("_hops", F.lit(0))).alias("hops"),
        cyclic.alias("is_cycle"),
        *([F.concat(F.array("_step"), F.coalesce("path", F.array().cast("array<string>"))).alias("path")]
          if with_path else []),
    )


def look_up(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """Add `missing_name`: NULL when (modname, qualname) exists, else its shortest missing prefix.

    Only the requests that fail are exploded into prefixes, and each distinct
    prefix is probed once.
    """
    asked = requests.select("modname", "qualname").distinct()
    have = objects.select("modname", "qualname").filter("qualname IS NOT NULL")
    failed = asked.join(have, ["modname", "qualname"], "left_anti")
    prefixes = explode_rows(
        failed, ["modname", "qualname"], N.prefix_names(col("qualname")), "prefix", pos="depth")
    absent = prefixes.join(
        have.withColumnRenamed("qualname", "prefix"), ["modname", "prefix"], "left_anti")
    first = absent.groupBy("modname", "qualname").agg(
        F.min_by("prefix", "depth").alias("missing_name"))
    return requests.join(first, ["modname", "qualname"], "left")


def look_up_through(requests: DataFrame, objects: DataFrame, aliases: DataFrame,
                    ends: DataFrame | None = None) -> DataFrame:
    """Look up each requested name, following refs wherever they stand on the way.

    `aliases`: modname, member_name (a name of any depth), target_mod, target_qual. Adds
    found_mod, found_qual, status (found, missing_module, missing_name) and missing_name.
    A round passes all plain parts up to the next ref at once, so names take one round more
    than the refs that they lead through, however many parts they have; refs are followed
    to their ends before. `ends`: what `resolve_aliases` gives for `aliases`, where it is known.
    """
    plain = objects.select(col("modname").alias("_m"), col("qualname").alias("_q"))
    ends = (resolve_aliases(aliases) if ends is None else ends).filter("NOT is_cycle").select(
        col("modname").alias("_m"), col("member_name").alias("_q"),
        col("final_mod").alias("_to_mod"), col("final_qual").alias("_to_qual"))
    # One table of places: an object has no onward path; a ref counts if it leads to an object.
    there = plain.select(col("_m").alias("_tm"), F.coalesce("_q", F.lit("")).alias("_tq"))
    places = written(
        ends.join(there, (col("_to_mod") == col("_tm"))
                  & (F.coalesce("_to_qual", F.lit("")) == col("_tq")), "left_semi")
        .unionByName(plain.filter("_q IS NOT NULL").select(
            "*", F.lit(None).cast("string").alias("_to_mod"), F.lit(None).cast("string").alias("_to_qual")))
    )
    modules = plain.filter("_q IS NULL").select(col("_m").alias("modname")).distinct()
    asked = requests.select("modname", "qualname").distinct()
    none = F.lit(None).cast("string")
    answers = [asked.join(modules, "modname", "left_anti").select(
        "modname", "qualname", none.alias("found_mod"), none.alias("found_qual"),
        F.lit("missing_module").alias("status"), none.alias("missing_name"))]
    active = written(asked.join(modules, "modname", "left_semi").select(
        "modname", "qualname", col("modname").alias("cur_mod"), col("qualname").alias("cur_qual")))
    while not active.isEmpty():
        here = written(active.join(
            there.withColumn("_there", F.lit(True)),
            (col("cur_mod") == col("_tm")) & (F.coalesce("cur_qual", F.lit("")) == col("_tq")), "left"
        ).drop("_tm", "_tq"))
        answers.append(here.filter("_there").select(
            "modname", "qualname", col("cur_mod").alias("found_mod"), col("cur_qual").alias("found_qual"),
            F.lit("found").alias("status"), none.alias("missing_name")))
        lost = here.filter("_there IS NULL").drop("_there")
        tried = explode_rows(lost, lost.columns, N.prefix_names(col("cur_qual")), "_prefix", pos="_at")
        is_ref = col("_to_mod").isNotNull()
        # The first ref on the way, and how many leading parts are objects.
        met = written(tried.join(
            places, (col("cur_mod") == col("_m")) & (col("_prefix") == col("_q")), "left"
        ).groupBy(*lost.columns).agg(
            F.min_by(F.when(is_ref, F.struct("_to_mod", "_to_qual", "_prefix")), F.when(is_ref, col("_at"))).alias("ref"),
            F.max(F.when(col("_m").isNotNull(), col("_at") + 1)).alias("_have")))
        unmet = F.size(N.parts(col("cur_qual"))) - F.coalesce("_have", F.lit(0))
        upto = (F.size(N.parts(col("qualname"))) - unmet + 1).cast("int")
        answers.append(met.filter("ref IS NULL").select(
            "modname", "qualname", none.alias("found_mod"), none.alias("found_qual"),
            F.lit("missing_name").alias("status"),
            F.call_function("substring_index", "qualname", F.lit("."), upto).alias("missing_name")))
        rest = F.substr("cur_qual", F.length("ref._prefix") + 2)
        active = met.filter("ref IS NOT NULL").select(
            "modname", "qualname", col("ref._to_mod").alias("cur_mod"),
            F.nullif(F.concat_ws(".", "ref._to_qual", F.nullif(rest, F.lit(""))), F.lit("")).alias("cur_qual"))
    answer = answers[0]
    for part in answers[1:]:
        answer = answer.unionByName(part)
    keyed = answer.withColumnRenamed("modname", "_rm").withColumnRenamed("qualname", "_rq")
    return requests.join(
        keyed,
        (col("modname") == col("_rm")) & col("qualname").eqNullSafe(col("_rq")), "left",
    ).drop("_rm", "_rq")


def resolve_names(names: DataFrame, objects: DataFrame) -> DataFrame:
    """Resolve dotted full names (column `name`) to (modname, qualname).

    `mod:qual` is split at its first colon. Otherwise the longest module prefix
    under which the rest exists wins, then `builtins`. An object's full name is one
    string, so all prefixes are tried by a single equi-join on it.
    """
    asked = names.select("name").distinct()
    fixed = asked.filter(col("name").contains(":")).select(
        "name", F.substring_index("name", ":", 1).alias("_m"),
        F.nullif(F.regexp_replace("name", r"^[^:]*:", ""), F.lit("")).alias("_q"))
    fixed_hits = fixed.join(
        objects.select("modname", "qualname"),
        (col("_m") == col("modname")) & col("_q").eqNullSafe(col("qualname")),
    ).select("name", "modname", "qualname")

    free = asked.filter(~col("name").contains(":"))
    keyed = objects.select(
        "modname", "qualname", N.full_name(col("modname"), col("qualname")).alias("name"))
    builtin = objects.filter((col("modname") == N.BUILTINS) & col("qualname").isNotNull()).select(
        "modname", "qualname", col("qualname").alias("name"))
    rank = F.when(col("_builtin"), -1).otherwise(F.length("modname"))
    hits = (
        free.join(
            keyed.withColumn("_builtin", F.lit(False))
            .unionByName(builtin.withColumn("_builtin", F.lit(True))), "name")
        .groupBy("name")
        .agg(F.max_by(F.struct("modname", "qualname"), rank).alias("p"))
        .select("name", "p.modname", "p.qualname")
    )
    return names.join(hits.unionByName(fixed_hits), "name", "left")


def exists(paths: DataFrame, objects: DataFrame) -> DataFrame:
    """The rows of `paths` whose (modname, qualname) is an object."""
    right = objects.select(col("modname").alias("_m"), col("qualname").alias("_q"))
    return paths.join(
        right,
        (col("modname") == col("_m")) & col("qualname").eqNullSafe(col("_q")), "left_semi")


def imposters(objects: DataFrame, places: DataFrame) -> DataFrame:
    """Add `is_imposter`: the claimed path is missing or leads to another object.

    `objects` carries object_id, claimed_mod, claimed_qual; `places` maps every
    (modname, qualname) to the object_id found there.
    """
    right = places.select(
        col("modname").alias("_m"), col("qualname").alias("_q"), col("object_id").alias("_found"))
    joined = objects.join(
        right,
        (col("claimed_mod") == col("_m")) & col("claimed_qual").eqNullSafe(col("_q")), "left")
    wrong = ~col("object_id").eqNullSafe(col("_found"))
    return joined.withColumn(
        "is_imposter", F.when(col("claimed_mod").isNull(), F.lit(False)).otherwise(wrong)
    ).drop("_m", "_q", "_found")


def really_mangled(objects: DataFrame, places: DataFrame) -> DataFrame:
    """Add `is_mangled`: the mangled form of the claimed path leads back to the object."""
    right = places.select(
        col("modname").alias("_m"), col("qualname").alias("_q"), col("object_id").alias("_found"))
    joined = objects.withColumn("_mangled", N.mangle(col("claimed_qual"))).join(
        right, (col("claimed_mod") == col("_m")) & (col("_mangled") == col("_q")), "left")
    same = F.coalesce(col("object_id") == col("_found"), F.lit(False))
    return joined.withColumn("is_mangled", same).drop("_m", "_q", "_found", "_mangled")


def import_edges(members: DataFrame) -> DataFrame:
    """Members stored as refs: found elsewhere than where they claim to be, or modules."""
    place_mod, place_qual = col("parent_mod"), N.child(col("parent_qual"), col("member_name"))
    moved = col("claimed_mod").isNotNull() & ~(
        (col("claimed_mod") == place_mod) & col("claimed_qual").eqNullSafe(place_qual))
    return members.filter(moved | (col("type_name") == "module")).select(
        "parent_mod", "parent_qual", "member_name",
        col("claimed_mod").alias("target_mod"), col("claimed_qual").alias("target_qual"))


def base_edges(types: DataFrame, column: str = "bases") -> DataFrame:
    """Ordered edges from an array of refs: modname, qualname, pos, base_mod, base_qual."""
    return types.select(
        "modname", "qualname", F.posexplode(column).alias("pos", "_ref")
    ).select(
        "modname", "qualname", col("pos").cast("bigint").alias("pos"),
        N.parse_ref(col("_ref"))["modname"].alias("base_mod"),
        N.parse_ref(col("_ref"))["qualname"].alias("base_qual"))


def mro_text(mro: Column) -> Column:
    """Method resolution order joined by arrows, names relative to nothing."""
    shown = F.transform(mro, lambda r: N.context_name(
        N.parse_ref(r)["modname"], N.parse_ref(r)["qualname"]))
    return F.array_join(shown, " → ")


def ancestor_closure(edges: DataFrame) -> DataFrame:
    """All ancestors of every node with the least distance.

    Edges: child, base. A round knows all pairs up to a distance of n and joins those of
    exactly n with all: every shortest way of n + 1 to 2n hops has a node n hops along it,
    so the distance doubles and each pair is found with its least one. A loop adds pairs
    only while its own length is not reached, so cycles end by themselves.

    Between rounds the ancestors of a node are arrays in one row, and only those of nodes
    that stand n hops above another are looked up. Every round shuffles the arrays by node;
    pairs become rows behind that shuffle, where the least distance is taken, so all that is
    found for one node meets in one task. The last round's pairs are not written.
    """
    pairs = edges.select("child", col("base").alias("ancestor"), F.lit(1).cast("bigint").alias("depth")).distinct()
    reach = 1
    while True:
        known = written(pairs.groupBy("child").agg(
            F.sort_array(F.collect_list(F.struct("depth", "ancestor"))).alias("_p")).select(
            "child", col("_p.ancestor").alias("_names"), col("_p.depth").alias("_depths")))
        far = explode_rows(known, ["child"], F.filter(
            F.arrays_zip("_names", "_depths"), lambda p: p["_depths"] == reach), "_far").select(
            "child", col("_far._names").alias("_via"))
        # Written, so that few of them are known to be few and `known` need not be shuffled to find them.
        vias = written(far.select(col("_via").alias("child")).distinct())
        near = written(known.join(vias, "child", "left_semi").select(
            col("child").alias("_via"), "_names", F.transform("_depths", lambda d: d + reach).alias("_depths")))
        # Merged by via, as rows of one via then stand together and their equal arrays are packed.
        ways = far.join(near.hint("merge"), "_via").select("child", "_names", "_depths")
        both = known.unionByName(ways).repartition("child")
        pairs = explode_rows(both, ["child"], F.arrays_zip("_names", "_depths"), "_p").groupBy(
            "child", col("_p._names").alias("ancestor")).agg(F.min("_p._depths").alias("depth"))
        reach *= 2
        if near.filter(F.array_contains("_depths", F.lit(reach).cast("bigint"))).isEmpty():
            return pairs


def linearize(edges: DataFrame) -> DataFrame:
    """Method resolution order of classes that have none stored, from their ordered bases.

    Edges: child, pos, base. Output: child, mro (the class first), NULL where the bases
    allow no order; a class below such a class or in a loop has none either. Classes are
    done level by level, as soon as all their bases are, so rounds are as many as the
    longest line of ancestors; a merge sees the orders of one class's bases only.
    """
    edges = written(edges.select("child", "pos", "base").distinct())
    nodes = edges.select(col("child").alias("name")).union(edges.select("base")).distinct()
    roots = nodes.join(edges.select(col("child").alias("name")).distinct(), "name", "left_anti")
    done = written(roots.select(col("name").alias("child"), F.array("name").alias("mro")))
    parts, fresh = [done], done
    waits = edges
    while not fresh.isEmpty():
        # A base is joined with its order once, in the round in which the order is found.
        waits = written(waits.join(fresh.select(col("child").alias("base"), col("mro").alias("_mro")), "base", "left")
                        .select("child", "pos", "base",
                                F.coalesce("_mro", "mro").alias("mro") if "mro" in waits.columns else col("_mro").alias("mro")))
        ready = waits.groupBy("child").agg(
            F.count_if(col("mro").isNull()).alias("open"),
            F.array_sort(F.collect_list(F.struct("pos", "base", "mro"))).alias("b")).filter("open = 0")
        fresh = written(ready.select(
            "child", _merged(F.col("child"), F.transform("b", lambda x: x["mro"]), F.transform("b", lambda x: x["base"])).alias("mro")))
        waits = waits.join(fresh.select("child"), "child", "left_anti")
        parts.append(fresh)
        fresh = fresh.filter("mro IS NOT NULL")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.unionByName(waits.select("child", F.lit(None).cast("array<string>").alias("mro")).distinct())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _merged(child: pd.Series, orders: pd.Series, bases: pd.Series) -> pd.Series:
    """The class, then its bases' orders merged so that each of them and the order of bases hold."""
    def one(name, lists):
        out, lists = [name], [list(x) for x in lists if len(x)]
        while lists:
            later = {n for x in lists for n in x[1:]}
            head = next((x[0] for x in lists if x[0] not in later), None)
            if head is None:
                return None
            out.append(head)
            lists = [y for y in ([n for n in x if n != head] for x in lists) if y]
        return out

    return pd.Series([one(c, [*o, b]) for c, o, b in zip(child, orders, bases)], dtype=object)
