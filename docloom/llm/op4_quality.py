"""Quality by weak supervision, in DataFrame operations only.

Each rule looks at one figure of a text and votes good, votes bad or abstains. The rules'
accuracies are not given: expectation-maximisation estimates, for either quality, how
often a rule casts each vote, and the share of good texts. A text's posterior probability
of being good replaces the all-must-pass filter.

The votes of all documents are counted by pattern first (at most 3^R patterns for R rules,
2,187 here, whatever the table), so each iteration is arithmetic on that small table. The
posterior is then an expression on the votes. Every count covers the whole table.

Null, empty and blank texts have no words: all counts 0, base_failed, not kept. An empty
table gives no rows. Repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import durable, query, table, words

WINDOW = 8
ITERATIONS = 60
KEEP = 0.5


def _repeated(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the hash of every window.

    Sorting (hash, place) brings equal windows together; no window is compared with all.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))
    after = F.concat(F.slice(pairs, 2, F.size(pairs)), F.array(none))
    before = F.concat(F.array(none), F.slice(pairs, 1, F.size(pairs) - 1))
    same = lambda p, q: F.when(p["h"] == q["h"], p["i"])
    marked = F.zip_with(F.zip_with(pairs, before, same), F.zip_with(pairs, after, same),
                        lambda a, b: F.coalesce(a, b))
    places = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, start, lambda a, i: F.struct(
        (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"].cast("bigint"))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("t"), words(F.col("text")).alias("w"))
    base = base.select("doc_id", "t", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("c"))
    n = F.size("w")
    # Single elements: `slice` would copy the whole array for every window.
    base = base.select("doc_id", "t", "w", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda s: F.xxhash64(*[F.get("c", s + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("h"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select("doc_id", "t", "w", "h", lines.alias("lines"))
    many = F.size(F.array_distinct("h")) < F.size("h")
    return base.select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        (F.size(F.split("t", "[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(many, _repeated(F.col("h"))).otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.rlike("[!|#*$%&<>]$"))).cast("bigint").alias("n_marked"))


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains. Thresholds are shares of words or lines."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def by(share: Column, good: float, bad: float) -> Column:
        return F.when(share <= good, 1).when(share >= bad, -1).otherwise(0)

    length = F.col("word_chars") / n
    return {
        "symbols": by(F.col("n_symbols") / n, 0.02, 0.1),
        "marked": by(F.col("n_marked") / n, 0.05, 0.3),
        "repeats": by(F.col("n_repeat_words") / n, 0.05, 0.3),
        "lines": by(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.05, 0.3),
        "words": F.when(F.col("n_words") >= 50, 1).when(F.col("n_words") < 20, -1).otherwise(0),
        "length": F.when(length.between(3.0, 7.5), 1).when((length < 2.2) | (length > 10), -1).otherwise(0),
        "line_words": F.when(n / F.greatest(F.col("n_lines"), F.lit(1)) >= 8, 1)
                       .when(n / F.greatest(F.col("n_lines"), F.lit(1)) < 3, -1).otherwise(0),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ITERATIONS) -> tuple[float, list[dict]]:
    """(log odds of good, for each rule the log odds of its votes) from counted patterns.

    Starts from majority votes; one count is added to each vote so that none is impossible.
    A rule's vote never counts against its own direction.
    """
    rules = len(patterns[0][0]) if patterns else 0
    post = [1 / (1 + math.exp(-float(sum(v)))) for v, _ in patterns]
    prior, odds = 0.0, [{1: 0.0, 0: 0.0, -1: 0.0} for _ in range(rules)]
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(post, patterns))
        bad = sum((1 - p) * n for p, (_, n) in zip(post, patterns))
        prior = math.log((good + 1) / (bad + 1))
        for r in range(rules):
            seen = {v: [1.0, 1.0] for v in (1, 0, -1)}
            for p, (vote, n) in zip(post, patterns):
                seen[vote[r]][0] += p * n
                seen[vote[r]][1] += (1 - p) * n
            odds[r] = {v: math.log(g / (good + 3)) - math.log(b / (bad + 3)) for v, (g, b) in seen.items()}
            odds[r] = {1: max(0.0, odds[r][1]), 0: 0.0, -1: min(0.0, odds[r][-1])}
        post = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(o[x] for o, x in zip(odds, v))))))
                for v, _ in patterns]
    return prior, odds


def judged(docs: DataFrame) -> DataFrame:
    """The counts, the votes' posterior and the verdict for every row."""
    rules = votes()
    counted = durable(figures(docs).withColumns({f"v_{k}": v for k, v in rules.items()}))
    names = [f"v_{k}" for k in rules]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    patterns = [(tuple(r[:-1]), r[-1]) for r in
                counted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    prior, odds = estimate(patterns)
    total = F.lit(prior)
    for name, o in zip(names, odds):
        total = total + F.when(F.col(name) == 1, o[1]).when(F.col(name) == -1, o[-1]).otherwise(o[0])
    p = 1 / (1 + F.exp(-total))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (p >= KEEP)).alias("kept"), p.alias("quality"))


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"))
