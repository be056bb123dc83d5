"""Chat formatting, importance resampling and periodic runs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import catalog, op11_chat, op12_resample, op13_periodic
from docloom.llm.op7_bpe import default_path
from tests.compare import check, connect
from tests.llm.conftest import ODD

TALK = "conv_id long, turn long, role string, text string, id int, part int, loss int"
HARD = ["", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<s", "<\\s>", "[INST", "a<|endoftext|>b", "x\n\ny  ", " lead", "\\[/INST]",
        "é😀ñ<s>　", "<<s>>", "[[INST]]", "\n", "tail\\"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_chats(rows):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in talks.items():
        said = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


@pytest.fixture(scope="module")
def chat():
    return op11_chat.load(default_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(
    st.sampled_from(["user", "assistant", "", "as\nsist", "assistant\\", "[INST]"]),
    st.lists(st.sampled_from([*HARD, "<", "s>", "/", "[", "]", "INST", " a", "é"]), max_size=6).map("".join)), max_size=5))
def test_rendered_turns_are_read_back_and_masked(turns):
    chat = op11_chat.load(default_path())
    text, spans = chat.render(turns)
    assert chat.read(text) == turns
    [(ids, offsets)] = chat.encode([text])
    loss = op11_chat.loss_mask(offsets, spans)
    assert op11_chat.masked(text, offsets, loss) == "".join(t for r, t in turns if r == "assistant")
    slow = [any(r == "assistant" and a < y and x < b for r, a, b in spans) for x, y in offsets.tolist()]
    assert loss.tolist() == slow
    assert [i for x in chat.encode([chat.render([t])[0] for t in turns]) for i in x[0].tolist()] == ids.tolist()


def test_control_strings_in_texts_are_no_marks(chat):
    for text in HARD:
        ids = chat.tokenizer.encode(chat.escape(text), add_special_tokens=False).ids
        assert not set(ids) & {chat.tokenizer.token_to_id(c) for c in chat.controls}


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TALK)


def got_chats(df):
    rows = df.collect()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("section", [40, op11_chat.SECTION])
def test_chats_equal_brute_force(spark, section):
    r = random.Random(3)
    roles = ["user", "assistant", "system", None, "tool\nname"]
    rows = [(c, t, r.choice(roles), r.choice([*HARD, None, "word " * 30])) for c in range(30) for t in range(r.randrange(1, 9))]
    rows += [(7000, t, roles[t % 2], f"turn {t} {HARD[t % len(HARD)]}") for t in range(600)]
    rows += [(5, 1, "user", "again"), (5, 1, "user", "again"), (None, 1, "assistant", "no id"), (None, None, "user", "first")]
    r.shuffle(rows)
    chats = op11_chat.format_chats(talk(spark, rows), section=section)
    assert got_chats(op11_chat.digests(chats)) == brute_chats(rows)


def test_chat_arrays_of_one_long_turn_and_no_rows(spark):
    long = "lange Wörter 😀 " * 60_000
    one = op11_chat.format_chats(talk(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", long)])).collect()
    assert sum(len(x.ids) for x in one) == sum(len(x.loss) for x in one) == sum(len(x.offsets) for x in one)
    loss = "".join(x.formatted[t.start:t.end] for x in one for t in x.turns if t.role == "assistant")
    assert loss == long
    empty = op11_chat.format_chats(talk(spark, [(1, 0, "user", "hi")]).limit(0))
    assert op11_chat.digests(empty).count() == 0


def test_chat_query_on_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert got_chats(catalog.QUERIES["op11_chat"](spark, data)) == brute_chats(rows)


def test_draw_equals_its_sql(spark, data):
    name = "op12_resample"
    assert check(spark, connect(data), data, name, catalog.QUERIES[name], catalog.CHECK_SQL[name]) is None


def test_codes_are_checksums_of_joined_words():
    found = op12_resample.words("Étude ÉTÉ a_b-C9\x00x  ß²")
    assert found == ["Étude".encode(), "ÉtÉ".encode(), b"a", b"b", b"c9", b"x", "ß²".encode()]
    levels = list(op12_resample.codes(found, 4))
    for size, level in enumerate(levels, 1):
        assert level == [zlib.crc32(b" ".join(found[i:i + size])) for i in range(len(found) - size + 1)]
    assert len(levels) == 4 and list(op12_resample.codes([], 3)) == [[]]


def brute_draw(rows, target, buckets, longest, percent, least):
    import math
    import re

    def features(text):
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = (collections.Counter(b for x in texts for b in features(x)[0]) for texts in ([x for _, x in rows], target))
    out = []
    for i, text in rows:
        f, n = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted([r for r in out if r[4] >= least], key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted((str(r[0]), *r[1:4], str(rank.get(id(r)))) for r in out)


@pytest.mark.parametrize(("longest", "least", "percent"), [(1, 20, 10), (3, 1, 50), (2, 0, 100)])
def test_draw_equals_brute_force(docs, spark, longest, least, percent):
    r = random.Random(longest)
    rows = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(60)))) for i in range(150)] + ODD
    target = ["w1 w2 w3 w4", None, "", "W5 w6!"]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = op12_resample.resample(docs(rows), items, buckets=97, longest=longest, least=least, percent=percent).collect()
    want = brute_draw(rows, target, 97, longest, percent, least)
    assert sorted((str(x.doc_id), x.n_features, x.weight, x.score, str(x["rank"])) for x in got) == want


def test_draw_of_odd_tables(odd, spark):
    none = spark.createDataFrame([], "text string")
    assert op12_resample.resample(odd, none).count() == len(ODD)
    assert op12_resample.resample(odd.limit(0), odd.select("text")).count() == 0


def brute_runs(w, least, power):
    n, best = len(w), {}
    for q in range(1, n // power + 1):
        k = 0
        while k + q < n:
            s = k
            while k + q < n and w[k] == w[k + q]:
                k += 1
            if k - s + q >= max(least, power * q):
                best.setdefault((s, k + q), q)
            k += k == s
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "power"), [(6, 4), (2, 2), (7, 3), (12, 5)])
def test_runs_equal_brute_force(least, power):
    r = random.Random(power)
    total = 0
    for _ in range(300):
        texts = []
        for _ in range(r.randrange(1, 5)):
            w = [b"%d" % r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(70))]
            at = r.randrange(len(w) + 1)
            w[at:at] = w[:r.randrange(1, 9)] * r.randrange(2, 14)
            texts.append(w)
        want = [brute_runs(w, least, power) for w in texts]
        assert op13_periodic.runs_of(texts, least, power) == want
        total += sum(map(len, want))
    assert total > 100


def brute_periodic(i, text):
    w = op13_periodic.words(text)
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w, 6, 4)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (str(i), len(runs), *map(str, top), str(1000 * top[1] // top[2] if runs else None),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), hashlib.sha256(kept).hexdigest())


def test_periodic_query_equals_brute_force(docs, spark, data, tmp_path):
    source = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    docs(source + ODD).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["op13_periodic"](spark, str(tmp_path)).collect()
    short = [(i, t) for i, t in source + ODD if len((t or "").split()) <= 3000]
    want = collections.Counter(brute_periodic(i, t) for i, t in short)
    found = collections.Counter(
        (str(r.doc_id), r.n_runs, str(r.start), str(r["length"]), str(r.period), str(r.exponent_milli), r.runs_sha256,
         r.collapsed_sha256) for r in got)
    assert len(got) == len(source) + len(ODD) and not want - found
    assert sum(r.n_runs > 0 for r in got) > 10


def test_periodic_of_long_and_no_documents(docs):
    many = [(1, "a " * 300_000), (2, " ".join(f"n{i} a b c d e f" for i in range(40_000))), (3, "x y z " * 50_000)]
    got = {r.doc_id: r for r in op13_periodic.periodic_runs(docs(many)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 300_000, 1)] and got[1].collapsed == "a"
    assert got[2].runs == [] and [tuple(x) for x in got[3].runs] == [(0, 150_000, 3)]
    assert op13_periodic.digests(op13_periodic.periodic_runs(docs(many).limit(0))).count() == 0


def test_groups_and_shared_words():
    codes = np.array([1, 2, 1, 2, 1, 2, 1, 2, 9])
    groups = op13_periodic.repeated(codes, 2)
    assert sorted(sorted(g.tolist()) for g in groups) == [[0, 2, 4, 6], [1, 3, 5]]
    for b, n in op13_periodic.shared(codes.tolist(), groups, 2).items():
        a = next(int(g[k - 1]) for g in groups for k in range(1, len(g)) if g[k] == b)
        assert codes[a:a + n].tolist() == codes[b:b + n].tolist() and codes[a + n:a + n + 1] != codes[b + n:b + n + 1]
