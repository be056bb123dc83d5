"""Queries with ordered-sequence operators over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators.sequence import Ordered
from docloom.plans.registry import query

col = F.col
W = "OVER (PARTITION BY conv_id ORDER BY turn)"


def _turns(t):
    return Ordered(t.read("conversations"), ["conv_id"], ["turn"])


@query("f01_first_flags", f"SELECT conv_id, turn, row_number() {W} = 1 AS is_first FROM conversations")
def first_flags(t):
    return _turns(t).first_flags().select("conv_id", "turn", "is_first")


@query("f02_last_flags", f"SELECT conv_id, turn, lead(turn) {W} IS NULL AS is_last FROM conversations")
def last_flags(t):
    return _turns(t).last_flags().select("conv_id", "turn", "is_last")


@query("f03_peek", f"SELECT conv_id, turn, lead(role, 1) {W} AS peeked, lead(role, 3) {W} AS further FROM conversations")
def peek(t):
    return _turns(t).neighbours({"peeked": ("role", 1), "further": ("role", 3)}).select(
        "conv_id", "turn", "peeked", "further")


@query("f04_take", f"SELECT conv_id, turn FROM conversations QUALIFY row_number() {W} <= 2")
def take(t):
    return _turns(t).take(2).select("conv_id", "turn")


@query("f05_tail", """SELECT conv_id, turn FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def tail(t):
    return _turns(t).tail(3).select("conv_id", "turn")


@query("f06_nth", """SELECT conv_id, coalesce(max(CASE WHEN rn = 4 THEN text END), 'none') AS nth FROM
(SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id""")
def nth(t):
    return _turns(t).nth(3, "text", default="none")


@query("f07_pairs", """SELECT user_id, event_type, next_event_type FROM (
SELECT user_id, event_type, lead(event_type) OVER w AS next_event_type, lead(event_id) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE n IS NOT NULL""")
def pairs(t):
    events = t.read("events").select("user_id", "ts", "event_type")
    return Ordered(events, ["user_id"], ["ts"]).pairs("event_type").select(
        "user_id", "event_type", "next_event_type")


@query("f08_blocks", """SELECT conv_id, block, string_agg(role, ',' ORDER BY rn) || repeat(',-', CAST(3 - count(*) AS INTEGER)) AS items FROM (
SELECT *, (rn - 1) // 3 AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations))
GROUP BY conv_id, block""")
def blocks(t):
    return _turns(t).blocks(3, "role", fill="-").withColumn("items", F.array_join("items", ","))


@query("f09_interleave", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY k, role) - 1 AS slot FROM (
SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)""")
def interleave(t):
    return _turns(t).interleave("role").select("conv_id", "turn", "role", "slot")


@query("f10_first_seen", """SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1""")
def first_seen(t):
    events = t.read("events").select("user_id", "ts", "event_type", "event_id")
    return Ordered(events, ["user_id"], ["ts"]).first_seen("event_type").drop("ts")


@query("f11_without_repeats", """SELECT user_id, event_id, event_type FROM (
SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS rn FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE rn = 1 OR was IS DISTINCT FROM event_type""")
def without_repeats(t):
    events = t.read("events").select("user_id", "ts", "event_id", "event_type")
    return Ordered(events, ["user_id"], ["ts"]).without_repeats("event_type").drop("ts", "pos")


@query("f12_first_true", """SELECT user_id, coalesce(min_by(event_id, ts) FILTER (WHERE value > 15), -1) AS found
FROM events GROUP BY user_id""")
def first_true(t):
    events = t.read("events").select("user_id", "ts", "event_id", "value")
    return Ordered(events, ["user_id"], ["ts"]).first_true(col("value") > 15, "event_id", default=-1).select(
        "user_id", col("found").cast("bigint").alias("found"))


def _digest(columns, seed):
    """Random key that DuckDB can compute as well: 60 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *[col(c).cast("string") for c in columns], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


DIGEST = "CAST('0x' || substr(md5({0} || ':{1}'), 1, 15) AS BIGINT)"


@query("f13_choose_each", f"""SELECT user_id, CAST(0 AS BIGINT) AS round, max_by(event_type, {DIGEST.format("user_id || ':' || event_id", 7)}) AS event_type FROM events GROUP BY user_id
UNION ALL SELECT user_id, 1, max_by(event_type, {DIGEST.format("user_id || ':' || event_id", 8)}) FROM events GROUP BY user_id""")
def choose_each(t):
    events = t.read("events").select("user_id", "event_id", "event_type")
    return Ordered(events, ["user_id"], ["event_id"], draw=_digest).choose_each(
        "event_type", repeat=2, seed=7)


def _customers(t):
    return Ordered(t.read("customer").select("c_custkey", "c_name"), (), ["c_custkey"], draw=_digest)


@query("f14_permutation", f"""SELECT c_custkey, c_name, row_number() OVER (ORDER BY {DIGEST.format("c_custkey", 7)}, c_custkey) - 1 AS pos FROM customer""")
def permutation(t):
    """Every customer with its place in the random order."""
    drawn = _customers(t).permutation(seed=7).withColumn("_draw", _digest(["c_custkey"], 7))
    return Ordered(drawn, (), ["_draw", "c_custkey"]).numbered.drop("_draw")


@query("f15_combination", f"""SELECT c_custkey, c_name FROM customer ORDER BY {DIGEST.format("c_custkey", 7)}, c_custkey LIMIT 100""")
def combination(t):
    return _customers(t).combination(100, seed=7)


@query("f16_combination_with_replacement", f"""SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey) AS copy FROM (
SELECT {DIGEST.format("id", 7)} % (SELECT count(*) FROM customer) AS pos FROM range(100) r(id)) d
JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) c ON c.pos = d.pos""")
def combination_with_replacement(t):
    return _customers(t).combination_with_replacement(100, seed=7).select(
        "c_custkey", "c_name", "copy")
