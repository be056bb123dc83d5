"""Toxicity by composed weighted finite-state machines over clauses.

A word becomes a symbol: the classes that it belongs to (self, target, copula, filler,
intent, harm, negation, report) in each language, and the weight of an insult. Five machines
read the symbols of a clause:

- target: is the next word said of somebody (`you are such a ...`, `those ...`)?
- insult: an insult is *aimed* if the target machine is ready for it or a target follows it
  at once, else it is *bare*;
- threat, one for each language: self, intent, harm and target in the order of that language
  with at most `GAP` other words between two of them;
- negation: the `NEAR` words after a negation, fillers and copulas not counted;
- report: what follows a verb of speech, or a word about words, up to the end of the clause.

They are composed on the fly: a state of the composed machine is the tuple of their states,
and its arcs are made when they are first walked and kept. An arc leaves a match: aimed,
bare or threat, and whether it is negated or reported. A match weighs its insult's learnt
weight (a threat `THREAT`), times `AIMED`, `DAMPED`, `REPORTED` as it applies. A bare match
is no proof: the heaviest bare match of a text counts `LONE` of its weight, only further ones
count whole; word beginnings, which are weaker than words, are never aimed.

Insults are learnt from labelled rows: whole words and beginnings of 4 to 6 letters that are
much likelier in toxic texts. At most `SAMPLE` rows of each label are read for it, chosen by a
hash; equal texts count once. At most `ENTRIES` entries are kept. A logistic curve over
evidence and length, fitted on the same rows, gives the score. Labels, language, source and
doc_id never enter a score.

Null and empty texts have no clause and get the score of no evidence. Labels that are
null, or contradict each other for one doc_id, are not learnt from. Without any toxic or
any clean label nothing is flagged. Repeated rows are scored each; other columns are kept out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import query, table

SAMPLE = 4000, 8000  # toxic rows, clean rows
EVIDENCE = 9.0  # nats by which an entry's counts must beat chance
ENTRIES = 20_000
THRESHOLD = 0.7
MOST = 300_000  # words and arcs that a task keeps; beyond, they are made anew
SHORTEST, LONGEST = 4, 6

# Word classes, by language.
SELF, TARGET, COPULA, FILLER, INTENT, HARM, NEGATION, REPORT = (1 << i for i in range(8))
CLASSES = {
    "en": {
        SELF: "i we", INTENT: "will shall gonna going must should ll",
        TARGET: "you your yours they them he him she her these those people",
        COPULA: "are is am was were be being re s", FILLER: "a an the such so very total complete real really to",
        HARM: "kill hurt beat break burn stab shoot hang punch strangle murder destroy smash die bleed suffer",
        NEGATION: "not no never nor neither without don doesn isn aren won",
        REPORT: "said says saying called calls wrote writes quoted quote claimed word words term"},
    "de": {
        SELF: "ich wir", INTENT: "werde werden will wollen wirst sollst", TARGET: "du dich dir euch ihr sie",
        COPULA: "bist seid ist sind", FILLER: "ein eine einen so ganz total der die das",
        HARM: "töten umbringen schlagen verprügeln brechen erschießen verbrennen sterben bluten",
        NEGATION: "nicht kein keine keinen nie weder", REPORT: "sagte sagt nannte schrieb wort begriff"},
    "fr": {
        SELF: "je nous", INTENT: "vais allons veux vas dois", TARGET: "tu te toi vous ils elles",
        COPULA: "es êtes est sont", FILLER: "un une si très vraiment le la les",
        HARM: "tuer frapper casser brûler battre étrangler crever mourir saigner",
        NEGATION: "ne pas jamais aucun aucune ni", REPORT: "dit disait appelle écrit mot terme"},
    "es": {
        SELF: "yo nosotros", INTENT: "voy vamos quiero vas debes a", TARGET: "tú ti te usted ustedes ellos",
        COPULA: "eres es son sois", FILLER: "un una tan muy el la los las",
        HARM: "matar matarte golpear golpearte romper romperte quemar pegar pegarte morir sangrar",
        NEGATION: "no ni nunca tampoco ningún ninguna", REPORT: "dijo dice llamó escribió palabra"},
}
LANGUAGES = tuple(CLASSES)
GAP, NEAR = 3, 3
THREAT, AIMED, LONE, DAMPED, REPORTED = 6.0, 1.5, 0.12, 0.07, 0.07

_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def _symbols() -> dict[str, tuple[int, ...]]:
    """Word -> its classes in each language."""
    out: dict[str, list[int]] = {}
    for at, lang in enumerate(LANGUAGES):
        for kind, words in CLASSES[lang].items():
            for w in words.split():
                out.setdefault(w, [0] * len(LANGUAGES))[at] |= kind
    return {w: tuple(m) for w, m in out.items()}


PLAIN = (0,) * len(LANGUAGES)
SYMBOLS = _symbols()

# An insult's strength in a symbol.
NONE, PART, WORD = 0, 1, 2


# Each machine: step(state, classes, strength) -> state. Classes are those of one language
# for the threat machine, and those of any language for the others.


def target_step(state: int, any_: int, strength: int) -> int:
    """1: a target stands before the next word, fillers and a copula between."""
    if any_ & TARGET:
        return 1
    return state if any_ & (COPULA | FILLER | NEGATION) else 0


def insult_step(state: int, aimed: int, any_: int, strength: int) -> tuple[int, str]:
    """State 1: a bare word of insult was just read. Output: bare, aimed, late (aimed after all) or none."""
    if strength == WORD:
        return (0, "aimed") if aimed else (1, "bare")
    if strength == PART:
        return 0, "bare"
    return 0, "late" if state and any_ & TARGET else ""


def threat_step(state: tuple, classes: int, object_first: bool) -> tuple[tuple, bool]:
    """State: what was read (self, intent, harm, target), and the gap since then.

    `object_first`: the harmed may stand before the harm (`ich werde dich schlagen`).
    """
    read, gap = state
    new = 0
    if classes & SELF:
        return (SELF, 0), False
    if classes & TARGET and not read & (SELF | INTENT):
        new = TARGET
    elif classes & TARGET and (read & HARM or object_first or not read & SELF):
        new = read | TARGET
    elif classes & INTENT and read & (SELF | TARGET):
        new = read | INTENT
    elif classes & HARM and read & INTENT:
        new = read | HARM
    if new:
        # I will hurt you; I am going to; you will die.
        done = new & (INTENT | HARM | TARGET) == INTENT | HARM | TARGET
        return ((0, 0) if done else (new, 0)), done
    if not read or gap == GAP:
        return (0, 0), False
    return (read, gap if classes & (COPULA | FILLER) else gap + 1), False


def negation_step(state: int, any_: int) -> int:
    """How many words a negation still reaches."""
    if any_ & NEGATION:
        return NEAR
    return state if any_ & (COPULA | FILLER) else max(0, state - 1)


def report_step(state: int, any_: int) -> int:
    return 1 if any_ & REPORT else state


START = (0, 0, ((0, 0),) * len(LANGUAGES), 0, 0)


def composed_step(state: tuple, classes: tuple[int, ...], strength: int) -> tuple[tuple, tuple]:
    """One arc of the composition: (next state, matches); a match is (kind, negated, reported)."""
    target, insult, threats, negated, reported = state
    any_ = 0
    for c in classes:
        any_ |= c
    insult, said = insult_step(insult, target, any_, strength)
    walked = [threat_step(t, c, lang != "en") for t, c, lang in zip(threats, classes, LANGUAGES)]
    found = [said] * bool(said) + ["threat"] * any(done for _, done in walked)
    marks = (negated > 0, reported > 0)
    after = (target_step(target, any_, strength), insult, tuple(t for t, _ in walked),
             negation_step(negated, any_), report_step(reported, any_))
    return after, tuple((kind, *marks) for kind in found)


def features(text: str | None) -> set[str]:
    """Whole words (marked by a stop) and word beginnings."""
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.add(w + ".")
        out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


class Grammar:
    """The composed machine with its arcs; `weights` is the learnt lexicon."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, tuple] = {}
        self.states: dict[tuple, int] = {START: 0}
        self.named = [START]
        self.symbols: dict[tuple, int] = {}
        self.arcs: dict[tuple[int, int], tuple[int, tuple]] = {}

    def word(self, w: str) -> tuple:
        """(weight, symbol, its number, languages whose harm / intent it is)."""
        get = self.weights.get
        whole = get(w + ".", 0.0)
        part = max((get(w[:n], 0.0) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)), default=0.0)
        weight, strength = (whole, WORD) if whole else (part, PART if part else NONE)
        classes = SYMBOLS.get(w, PLAIN)
        symbol = (classes, strength)
        calls = 0
        for at, c in enumerate(classes):
            calls |= (bool(c & HARM) | 2 * bool(c & INTENT)) << 2 * at
        if len(self.known) > MOST:
            self.known.clear()
        entry = weight, symbol, self.symbols.setdefault(symbol, len(self.symbols)), calls
        self.known[w] = entry
        return entry

    def arc(self, state: int, symbol: tuple, number: int) -> tuple[int, tuple]:
        after, matches = composed_step(self.named[state], *symbol)
        full = len(self.arcs) > MOST
        if full:
            for part in (self.states, self.named, self.arcs):
                part.clear()
            self.states[START] = 0
            self.named.append(START)
        if after not in self.states:
            self.states[after] = len(self.named)
            self.named.append(after)
        made = self.states[after], matches
        if not full:
            self.arcs[state, number] = made
        return made

    def clause(self, entries: list[tuple]) -> tuple[float, list[float]]:
        """(evidence of aimed insults and threats, weights of bare insults)."""
        state, sure, bare, last = 0, 0.0, [], 0.0
        arcs = self.arcs
        for weight, symbol, number, _ in entries:
            state, matches = arcs.get((state, number)) or self.arc(state, symbol, number)
            for kind, negated, reported in matches:
                x = (DAMPED if negated else 1.0) * (REPORTED if reported else 1.0)
                if kind == "bare":
                    last = weight * x
                    bare.append(last)
                elif kind == "late":
                    bare.pop()
                    sure += last * AIMED
                else:
                    sure += x * (THREAT if kind == "threat" else weight) * AIMED
        return sure, bare

    def evidence(self, text: str | None) -> tuple[float, int, int]:
        """(evidence, matched clauses, words)."""
        sure, rest, top = 0.0, 0.0, 0.0
        n = size = 0
        known = self.known
        for part in _CLAUSE.split((text or "").lower()):
            entries = [known.get(w) or self.word(w) for w in _WORD.findall(part)]
            size += len(entries)
            calls = 0
            insult = False
            for e in entries:
                if e[0]:
                    insult = True
                calls |= e[3]
            # Only a clause with an insult, or with harm and intent of one language, can match.
            if not insult and not calls & calls >> 1 & 0x55555555:
                continue
            x, bare = self.clause(entries)
            n += bool(x or bare)
            sure, rest, top = sure + x, rest + sum(bare), max(top, *bare, 0.0)
        return sure + rest - top + LONE * top, n, size


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` toxic and clean rows outside the held-out third; equal texts once."""
    clear = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
             .filter("crc32(cast(cast(doc_id AS string) AS binary)) % 3 != 1")
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high"))
             .filter("toxic = high").select("doc_id", "toxic"))
    picked = [clear.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
              for t, most in ((1, sample[0]), (0, sample[1]))]
    # At most sum(sample) rows of two numbers.
    wanted = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "toxic")
    return rows.dropDuplicates(["text", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[dict, list]:
    """The lexicon and the calibration (bias, slopes of evidence and length), from a bounded sample."""
    rows = training_rows(docs, labels, sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(f, t) for text, t in zip(pdf["text"], pdf["toxic"]) for f in features(text)]
            yield pd.DataFrame(pairs, columns=["feature", "toxic"]).value_counts().reset_index(name="n")

    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}, [-3.0, 0.0, 0.0]
    counts = (rows.mapInPandas(count, "feature string, toxic int, n long")
              .groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"),
                                      F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b")))
    weight = (F.log((F.col("a") + 0.5) / (bad + 1.0)) - F.log((F.col("b") + 0.5) / (good + 1.0)))
    share = bad / (bad + good)
    n = F.col("a") + F.col("b")
    chance = (F.col("a") * F.log(F.col("a") / (n * share))
              + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0.0))
    chosen = (counts.filter("a > 0").withColumn("weight", F.round(weight, 6))
              .filter((F.col("weight") >= 3.0) & (chance >= EVIDENCE))
              .orderBy(F.desc("weight"), "feature").limit(ENTRIES))
    lexicon = {r.feature: r.weight for r in chosen.collect()}

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Grammar(lexicon)
        for pdf in batches:
            seen = [_signal(g.evidence(t)) for t in pdf["text"]]
            yield pd.DataFrame({"x": [s[0] for s in seen], "z": [s[1] for s in seen], "y": pdf["toxic"]})

    seen = rows.mapInPandas(weigh, "x double, z double, y int").collect()  # at most sum(sample) rows
    return lexicon, _logistic([(r.x, r.z, r.y) for r in seen])


def _signal(evidence: tuple[float, int, int]) -> tuple[float, float]:
    found, _, size = evidence
    return math.log1p(found), math.log1p(size)


def _logistic(points: list[tuple[float, float, int]]) -> list[float]:
    """Bias and slopes by Newton steps, both labels with the same total weight, lightly damped.

    Evidence may only raise a score, and length alone only lower it; a slope of the other
    sign is left out.
    """
    data = np.array(points, dtype=float)
    y = data[:, 2]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def fit(columns: list[int]) -> np.ndarray:
        x = np.column_stack([np.ones(len(y)), data[:, columns]])
        b = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            slope = x.T @ (weight * (y - p)) - 1e-4 * b
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(b))
            b = b + np.linalg.solve(bend, slope)
        return b

    b = fit([0, 1])
    if b[2] > 0:
        b = np.append(fit([0]), 0.0)
    return [float(b[0]), max(0.0, float(b[1])), float(b[2])]


def score(docs: DataFrame, model: tuple[dict, list], text: str = "text") -> DataFrame:
    """Add `toxicity`: the score and the number of matched clauses of every row."""
    lexicon, (bias, slope, long) = model

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        g = Grammar(lexicon)
        for texts in batches:
            out = []
            for t in texts:
                e = g.evidence(t)
                x, z = _signal(e)
                out.append((1 / (1 + math.exp(-max(-700.0, bias + slope * x + long * z))), e[1]))
            yield pd.DataFrame(out, columns=["score", "n_clauses"])

    scored = F.pandas_udf(run, "score double, n_clauses long")
    return docs.withColumn("toxicity", scored(F.col(text)))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, folder, "labels")))
    held = F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1")
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("toxicity.n_clauses").alias("n_clauses"))
