"""Language of web pages by Bayesian fusion of evidence.

The posterior of a page's language multiplies three kinds of evidence:
- text: likelihood of the letter pairs of its visible text under each language;
- markup: probability of the declared `lang` given the language, from grouped counts;
- address: a prior of the host, smoothed by its domain, that by its suffix (last label), and
  that by all pages; each level is a grouped sum of the text posteriors, less the page's own.

The letter-pair model is fitted on at most `SAMPLE` rows of `documents` for each language,
chosen by a hash; it has at most `PAIRS` pairs, and every language that a document states.
Counts of hosts, suffixes and declarations cover all pages. Sums are combined before they are
shuffled, so a hot host is one row from each task. Fewer than `SHARE` hosts can hold more than
one page in `SHARE` each; their priors are broadcast, so that no join key of the other pages is
hot. Hosts meet their domains and suffixes in the same way. Declarations have two or three
letters, so their table is bounded too.

Null or empty html has no text evidence; null or odd addresses have the prior of all pages;
a page without declaration has none. Every page gives one row, also when page_id is null or
repeated. Without any labelled document the language is null. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import durable, query, small_batches, table

SAMPLE = 500
PAIRS = 20_000
TEMPER = 0.3  # letter pairs of one text are far from independent
HOST, DOMAIN, SUFFIX, DECLARED = 20.0, 20.0, 20.0, 5.0  # pseudo-counts of each level
SHARE = 1000  # a key with more than one row in SHARE is hot

_HIDDEN = re.compile(r"<(script|style)\b[^>]*>(?:(?!</\1)[\s\S])*+(?:</\1[^>]*>)?|<!--(?:(?!-->)[\s\S])*+(?:-->)?", re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def visible(html: str | None) -> str:
    return unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html or "")))


def pairs(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    words = f" {' '.join(_LETTERS.findall(text.lower()))} "
    for a, b in zip(words, words[1:]):
        counts[a + b] = counts.get(a + b, 0) + 1
    return counts


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(languages, log-probabilities of each pair, those of an unseen pair)."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    if not languages:
        return [], {}, []
    order = Window.partitionBy("lang").orderBy("chosen", "doc_id", F.xxhash64("text"))
    picked = (labelled.select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("chosen"))
              .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= sample).select("lang", "text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(lang, p, n) for lang, t in zip(pdf["lang"], pdf["text"]) for p, n in pairs(t).items()]
            frame = pd.DataFrame(rows, columns=["lang", "pair", "n"])
            yield frame.groupby(["lang", "pair"], as_index=False)["n"].sum()

    counts = (small_batches(picked).mapInPandas(count, "lang string, pair string, n long")
              .groupBy("pair", "lang").agg(F.sum("n").alias("n")))
    known = (counts.groupBy("pair").agg(F.sum("n").alias("all"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("n")).orderBy(F.desc("all"), "pair").limit(PAIRS).collect())
    totals = {lang: sum(r.n.get(lang, 0) for r in known) + 0.5 * (len(known) + 1) for lang in languages}
    model = {r.pair: [math.log((r.n.get(x, 0) + 0.5) / totals[x]) for x in languages] for r in known}
    return languages, model, [math.log(0.5 / totals[x]) for x in languages]


def text_evidence(pages: DataFrame, model) -> DataFrame:
    """Add `seen`: declared language and the log-likelihood of the text for each language."""
    languages, weights, unseen = model

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table_ = {k: np.array(v) for k, v in weights.items()}
        rare = np.array(unseen)
        for texts in batches:
            out = []
            for html in texts:
                total = np.zeros(len(languages))
                for p, n in pairs(visible(html)).items():
                    total += n * table_.get(p, rare)
                found = _LANG.search(html or "")
                out.append((found[1].lower() if found else None, (TEMPER * total).tolist()))
            yield pd.DataFrame(out, columns=["declared", "text"])

    seen = F.pandas_udf(run, "declared string, text array<double>")
    return small_batches(pages).withColumn("seen", seen("html"))


def _posterior(logs):
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def look_up(rows: DataFrame, priors: DataFrame, key: str, total: int, share: int = SHARE) -> DataFrame:
    """`rows` with the columns of `priors`, which has one row a key with `n`, its number of `rows`.

    Fewer than `share` keys can hold more than one of `total` rows in `share`; those are broadcast.
    """
    hot = F.col("n") * share > total
    few = F.broadcast(priors.filter(hot).drop("n"))
    rest = rows.join(few.select(key), key, "left_anti").join(priors.filter(~hot).drop("n"), key, "left")
    return rows.join(few, key).unionByName(rest)


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE, share: int = SHARE) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host: one row for each page."""
    model = fit(docs, sample)
    languages = model[0]
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    seen = text_evidence(pages.select("page_id", "url", "html"), model).select(
        "page_id", F.coalesce(host, F.lit("")).alias("host"), "seen.declared", "seen.text")
    if not languages:
        none = F.lit(None).cast("string")
        return seen.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"),
                           none.alias("text_lang"), "declared", "host")
    k = len(languages)
    seen = durable(seen.withColumn("own", _posterior(F.col("text"))))
    one = [F.sum(F.element_at("own", i + 1)).alias(f"s{i}") for i in range(k)]
    vector = lambda p="s": F.array(*[F.col(f"{p}{i}") for i in range(k)])
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    hosts = durable(seen.groupBy("host").agg(*one, F.count("*").alias("n"))
                    .withColumn("domain", F.substring_index("host", ".", -2))
                    .withColumn("suffix", F.substring_index("host", ".", -1)))
    many = F.count("*").alias("n")
    domains = hosts.groupBy("domain").agg(*add, many).select("domain", "n", vector().alias("vd"))
    suffixes = hosts.groupBy("suffix").agg(*add, many).select("suffix", "n", vector().alias("vs"))
    *total, n_pages, n_hosts = (x or 0 for x in hosts.agg(*add, F.sum("n"), F.count("*")).first())
    base = [(x + 1.0) / (sum(total) + k) for x in total]
    levels = hosts.select("host", "domain", "suffix", F.col("n").alias("held"), vector().alias("vh"))
    levels = look_up(look_up(levels, domains, "domain", n_hosts, share), suffixes, "suffix", n_hosts, share)
    levels = durable(levels.select("host", F.col("held").alias("n"), "vh", "vd", "vs"))
    stated = seen.filter("declared IS NOT NULL").groupBy("declared").agg(*one).select("declared", vector().alias("vm"))
    joined = look_up(seen, levels, "host", n_pages, share).join(F.broadcast(stated), "declared", "left")
    start = F.array(*[F.lit(x) for x in base])

    def level(counts: str, strength: float, under):
        """Counts less the page's own, smoothed by the level under it."""
        rest = F.zip_with(F.col(counts), F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))
        n = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, under, lambda c, u: (c + strength * u) / (n + strength))

    joined = joined.withColumn("ps", level("vs", SUFFIX, start))
    joined = joined.withColumn("pd", level("vd", DOMAIN, F.col("ps")))
    joined = joined.withColumn("ph", level("vh", HOST, F.col("pd")))
    share = F.zip_with("vm", "own", lambda c, o: F.greatest(c - o, F.lit(0.0)))
    # P(declared | language) up to the factor that all languages share.
    said = F.zip_with(share, F.array(*[F.lit(float(x)) for x in total]), lambda c, t: F.log((c + DECLARED / k) / (t + DECLARED)))
    logs = F.zip_with(F.zip_with("text", "ph", lambda t, p: t + F.log(p)),
                      F.coalesce(said, F.array(*[F.lit(0.0)] * k)), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return joined.withColumn("all", _posterior(logs)).select(
        "page_id", best(F.col("all")).alias("lang"), F.array_max("all").alias("confidence"),
        best(F.col("own")).alias("text_lang"), "declared", "host")


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "pages"), table(spark, folder, "documents"))
