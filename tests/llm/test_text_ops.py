"""Row-wise operators: tokens, toxicity, quality, pseudonyms."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import op2_toxicity, op4_quality, op7_bpe, op8_token_counts, op9_pii
from tests.llm.conftest import ODD


def test_bpe_equals_the_library(odd, spark, data):
    library = Tokenizer.from_file(op7_bpe.default_path())
    texts = [t or "" for _, t in ODD]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()]
    bpe = op7_bpe.Bpe(op7_bpe.default_path())
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = op7_bpe.digests(odd).collect()
    assert len(got) == len(ODD)
    want = {hashlib.sha256(np.array(bpe.encode(t or ""), "<u4").tobytes()).hexdigest() for _, t in ODD}
    assert {r.ids_sha256 for r in got} == want


def test_cuts_never_split_a_token():
    bpe = op7_bpe.Bpe(op7_bpe.default_path())
    assert all(entry[i:i + 2] not in bpe.cut for entry in bpe.ids for i in range(len(entry) - 1))
    assert b"".join(bpe.fragments_of(b" tionqxhjword")) == b" tionqxhjword"
    assert len(bpe.fragments_of(b" tionqxhjword")) > 1


def best_count(word: bytes, score: dict) -> int:
    """Every segmentation of a short word."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        if all(p in score for p in parts):
            total = 0.0
            for p in parts:
                total += score[p]
            best = max(best or (-math.inf, 0), (round(total, 9), -len(parts)))
    return -best[1]


def test_trie_counts_equal_all_segmentations(odd):
    ids = op7_bpe.Bpe(op7_bpe.default_path()).ids
    counter = op8_token_counts.Counter(ids)
    words = [" thing", " things", "thinking", " the", "é", " zqxj", "ation", " nation", "a"]
    counter.counts(words)
    assert {w: counter.known[w] for w in words} == {w: best_count(w.encode(), counter.score) for w in words}
    got = op8_token_counts.token_counts(odd.select("doc_id", "text", "n_chars")).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if not r.text} == {0}


def test_grammar_scores_clauses():
    g = op2_toxicity.Grammar({"idiot.": 4.0, "scum.": 3.0, "acht": 3.5})
    plain = g.evidence("there is an idiot here")
    assert plain[0] == 4.0 * op2_toxicity.LONE and plain[1:] == (1, 5)
    aimed = g.evidence("you are such an idiot")[0]
    assert aimed == g.evidence("these idiot")[0] == g.evidence("an idiot you are")[0] == 6.0 > plain[0]
    assert g.evidence("that is not an idiot")[0] < plain[0]
    assert g.evidence("you are not an idiot")[0] < plain[0]
    assert g.evidence("someone said you idiot")[0] < plain[0]
    assert g.evidence("the word scum appears here")[0] < plain[0]
    assert g.evidence("you achtung")[0] == 3.5 * op2_toxicity.LONE  # beginnings are not aimed
    assert g.evidence("idiot. scum.")[1] == 2
    assert g.evidence("an idiot. a scum.")[0] == 3.0 + 4.0 * op2_toxicity.LONE
    assert g.evidence(None) == g.evidence("") == (0.0, 0, 0)


@pytest.mark.parametrize("text, threat", [
    ("I will break your legs", True), ("we are going to kill them", True), ("you will die", True),
    ("ich werde dich töten", True), ("je vais te tuer", True), ("voy a matarte", False),
    ("yo voy a golpear a ti", True), ("I will beat the eggs", False), ("sie will die Blumen", False),
    ("they kill time", False), ("your legs will break", True), ("we will see you and then burn wood", False),
    ("I will go home now and then we saw people hurt", False)])
def test_threats(text, threat):
    assert (op2_toxicity.Grammar({}).evidence(text)[0] > 0) == threat


def separate(words, weights):
    """What each machine says of every place, from the rules alone, without states."""
    sym = [op2_toxicity.SYMBOLS.get(w, op2_toxicity.PLAIN) for w in words]
    any_ = [np.bitwise_or.reduce(s) for s in sym]
    is_a = lambda i, kinds: bool(any_[i] & kinds)
    light = op2_toxicity.COPULA | op2_toxicity.FILLER
    whole = [w in weights for w in words]

    def aimed(i):
        back = next((j for j in range(i - 1, -1, -1)
                     if is_a(j, op2_toxicity.TARGET) or not is_a(j, light | op2_toxicity.NEGATION)), None)
        return back is not None and is_a(back, op2_toxicity.TARGET)

    def negated(i):
        last = max((j for j in range(i) if is_a(j, op2_toxicity.NEGATION)), default=None)
        return last is not None and sum(not is_a(j, light) for j in range(last + 1, i)) < op2_toxicity.NEAR

    sure, bare = 0.0, []
    for i, w in enumerate(words):
        factor = (op2_toxicity.DAMPED if negated(i) else 1.0) * (
            op2_toxicity.REPORTED if any(is_a(j, op2_toxicity.REPORT) for j in range(i)) else 1.0)
        if not whole[i]:
            continue
        x = weights[w] * factor
        if aimed(i) or (i + 1 < len(words) and is_a(i + 1, op2_toxicity.TARGET) and not whole[i + 1]):
            sure += x * op2_toxicity.AIMED
        else:
            bare.append(x)
    return sure, bare


def test_composition_equals_separate_machines():
    weights = {"idiot": 4.0, "scum": 3.0}
    g = op2_toxicity.Grammar({f"{w}.": x for w, x in weights.items()})
    vocabulary = ["you", "are", "an", "idiot", "scum", "not", "said", "tree", "these", "kein", "pas", "word"]
    rng = np.random.default_rng(7)
    for _ in range(3000):
        words = [vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(1, 12))]
        sure, bare = g.clause([g.word(w) for w in words])
        want = separate(words, weights)
        assert sure == pytest.approx(want[0]) and bare == pytest.approx(want[1]), words
    # Walked arcs give what fresh steps give.
    for (state, number), (after, matches) in g.arcs.items():
        symbol = next(s for s, n in g.symbols.items() if n == number)
        assert op2_toxicity.composed_step(g.named[state], *symbol) == (g.named[after], matches)


def test_arcs_are_made_anew_beyond_their_number(monkeypatch):
    text = "you are not an idiot and I will hurt your tree, said these scum of an idiot. you idiot"
    weights = {"idiot.": 4.0, "scum.": 3.0}
    want = op2_toxicity.Grammar(weights).evidence(text)
    monkeypatch.setattr(op2_toxicity, "MOST", 2)
    assert op2_toxicity.Grammar(weights).evidence(text) == want


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op2_toxicity.op2_toxicity(spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_held_out_precision_and_recall(spark):
    folder = "/root/testdata/sf0.1"
    got = op2_toxicity.op2_toxicity(spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits >= 0.95 * sum(r.predicted for r in got)
    assert hits >= 0.87 * sum(r.toxic for r in got)


def test_toxicity_of_odd_rows_and_without_labels(odd, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = op2_toxicity.learn(odd, labels)
    got = op2_toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(r.toxicity.score < 0.7 for r in got)
    assert op2_toxicity.score(odd.limit(0), model).count() == 0


def brute_figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_quality_figures_equal_brute_force(docs, spark, data):
    rows = ODD + [(10 + r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    got = op4_quality.judged(docs(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r.doc_id or 0, *(r[n] for n in names)) for r in got) == sorted(
        (i or 0, *brute_figures(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert op4_quality.judged(docs([])).count() == 0


def test_em_finds_the_accurate_rules():
    # Two rules agree with the hidden label nine times in ten, the third is a coin.
    counts = collections.Counter()
    for q in (1, -1):
        for votes in itertools.product((1, -1), repeat=3):
            p = (0.9 if votes[0] == q else 0.1) * (0.9 if votes[1] == q else 0.1) * 0.5
            counts[votes] += round(10_000 * p)
    _, odds = op4_quality.estimate(sorted(counts.items()))
    assert odds[0][1] > 1 > odds[2][1] and odds[1][-1] < -1 < odds[2][-1]


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", text))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms_keep_format_and_links(docs):
    line = ("mail bosbt.42@mail8.example.com or +1 (464) 555-9887, card 4387513035237269, "
            "4111-1111-1111-1111, on 2024-02-29 and 31/12/1999, at 43.203.110.141")
    got = op9_pii.pseudonymise(docs([(1, line), (2, "Again: " + line), (3, "2001-13-01 1234567890123456 none")])).orderBy("doc_id").collect()
    assert got[1].text == "Again: " + got[0].text
    assert got[2].text == "2001-13-01 1234567890123456 none" and got[2].n_changed == 0
    assert re.sub(r"\d", "9", re.sub("[a-z]", "a", got[0].text)) == re.sub(r"\d", "9", re.sub("[a-z]", "a", line))
    assert all(luhn(x) for x in re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", got[0].text))
    for old in ("bosbt.42@", "464) 555-9887", "4387513035237269", "1111-1111", "2024-02-29", "203.110"):
        assert old not in got[0].text



def test_secrets_in_any_case_and_spacing(docs):
    lines = ['TOKEN = "9233A8BC04"', "token='9233a8bc04'", "Password=hunter2x", 'PASSWORD  =  "hunter2x"',
             "password=1234567890123456", "password=4387513035237269", "password=hunter"]
    got = [r.text for r in op9_pii.pseudonymise(docs(list(enumerate(lines)))).orderBy("doc_id").collect()]
    for old, new in zip(lines, got):
        value = re.search(r"\w+\W*$", old)[0]
        assert new != old and value not in new and new.startswith(old[:-len(value)]) and len(new) == len(old)
    assert re.search("=(.*)", got[2])[1] == re.search('"(.*)"', got[3])[1]
    kept = ["password is set", "token = word", "the token"]
    assert [r.text for r in op9_pii.pseudonymise(docs(list(enumerate(kept)))).orderBy("doc_id").collect()] == kept


def test_secrets_are_whole(docs):
    secrets = [("password=", "hun-ter$2x9", ""), ('password="', "my secret word", '" and more'), ("pwd=", "abcd", " x"),
               ("token=", "abc123def", "."), ("secret: ", "s3cr-et", ""), ("API_KEY = '", "k9/x+y", "'"),
               ("password: ", "x1", ", then"), ("Passwort=", "größe7", " und"), ("mail ", "josé.nuñez", "@ex.com now")]
    lines = ["".join(s) for s in secrets]
    got = [r.text for r in op9_pii.pseudonymise(docs(list(enumerate(lines)))).orderBy("doc_id").collect()]
    for (before, value, after), new in zip(secrets, got):
        fresh = new[len(before):len(new) - len(after)]
        assert new.startswith(before) and new.endswith(after) and len(fresh) == len(value), new
        # Every part of letters and digits changes; what is not ASCII stays.
        for old_part, new_part in zip(re.findall("[A-Za-z0-9]+", value), re.findall("[A-Za-z0-9]+", fresh)):
            assert len(old_part) < 3 or old_part != new_part
        assert fresh != value and re.sub("[a-z]", "a", re.sub(r"\d", "9", fresh)) == re.sub("[a-z]", "a", re.sub(r"\d", "9", value))
    kept = ["password: see below", "the secret: never give up", "token: next", 'he said "secret" to all', "tokens = [a, b]"]
    assert [r.text for r in op9_pii.pseudonymise(docs(list(enumerate(kept)))).orderBy("doc_id").collect()] == kept


def test_key_of_the_session(docs, spark):
    rows = docs([(1, "call 555-123-4567"), (2, "on 2024-02-03")])
    texts = lambda df: [r.text for r in df.orderBy("doc_id").collect()]
    public = texts(op9_pii.pseudonymise(rows))
    try:
        spark.conf.set(op9_pii.SETTING, "another")
        assert texts(op9_pii.pseudonymise(rows)) == texts(op9_pii.pseudonymise(rows, key="another")) != public
    finally:
        spark.conf.unset(op9_pii.SETTING)
    assert texts(op9_pii.pseudonymise(rows)) == public


def test_cards_beside_other_numbers(docs):
    card = "4387513035237269"
    spaced = "4111 1111 1111 1111"
    lines = [f"{card} 123", f"{card} 7 of 9", f"12 {card}", f"{spaced} 123", f"2024 {spaced} 99", f"123456 {spaced} 123456",
             f"{spaced} {card}", f"5 2024-02-29 {card}", f"7 555-123-4567 {spaced}"]
    got = [r.text for r in op9_pii.pseudonymise(docs(list(enumerate(lines)))).orderBy("doc_id").collect()]
    for old, new in zip(lines, got):
        assert card not in new and "1111 1111" not in new and re.sub(r"\d", "9", old) == re.sub(r"\d", "9", new)
    assert "2024-02-29" not in got[7] and "555-123-4567" not in got[8]
    long = "1234567 " * 3 + "9" * 30_000
    assert op9_pii.pseudonymise(docs([(1, long)])).first().text[24:] == "9" * 30_000

def test_pseudonyms_are_one_to_one(spark):
    from pyspark.sql import functions as F
    ips = spark.range(300).select(F.concat(F.lit("9.8.7."), "id").alias("v")).filter("v rlike '[.][0-9]$|[.]1?[0-9][0-9]$'")
    got = ips.select(op9_pii.pseudonym(F.col("v")).alias("p")).distinct().count()
    assert got == ips.count()
    days = spark.sql("SELECT explode(sequence(date'1999-01-01', date'2001-12-31')) AS v").selectExpr("cast(v AS string) AS v")
    fresh = days.select(op9_pii.pseudonym(F.col("v")).alias("p"))
    assert fresh.distinct().count() == days.count()
    assert fresh.filter("try_to_date(p) IS NULL").count() == 0


def test_pseudonyms_of_odd_rows(odd):
    got = op9_pii.pseudonymise(odd.withColumn("found", odd.a)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t in ODD)
    assert op9_pii.pseudonymise(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "x" * 49, "x" * 5000])
def test_long_texts_have_no_token_limit(text):
    bpe = op7_bpe.Bpe(op7_bpe.default_path())
    assert bpe.decode(bpe.encode(text)) == text
