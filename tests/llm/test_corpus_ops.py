"""Operators that compare documents, and the pipeline, against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest

import corpus_pipeline
from docloom.llm import (
    catalog,
    op1_chaining,
    op3_decontaminate,
    op5_minhash,
    op6_language,
    op10_suffix,
)
from docloom.llm.components import components
from tests.compare import check, connect
from tests.llm.conftest import ODD


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_equal_brute_force(docs):
    base = words(150, 1)
    rows = [(i, " ".join(words(120, 100 + i))) for i in range(20)]
    text = list(base)
    for i in range(20, 40):  # a chain: each copy differs a little from the one before
        text[(i * 37) % 150] = f"edit{i}"
        rows.append((i, " ".join(text)))
    rows += [(50, "Same TEXT"), (51, "same text"), (60, None), (61, ""), (62, " \n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute_components(rows)


def test_a_bucket_of_copies_too_far_to_link(docs):
    """Every text shares buckets with most others, few are similar enough, none next to the pivot."""
    base, rows = words(120, 7), []
    for i in range(60):
        r = random.Random(i)
        text = list(base)
        for at in range(0, 120, 12 if i % 3 else 24):
            text[min(119, at + r.randrange(12))] = f"own{i}x{at}"
        rows.append((i, " ".join(text)))
    for i in range(0, 60, 7):
        rows.append((100 + i, rows[i][1] + " tail"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute_components(rows)
    assert 20 < len({c for _, c in got.values()}) < len(rows)
    one = {r.doc_id: (r.n_shingles, r.component_id)
           for r in op5_minhash.near_duplicates(docs(rows), rounds=1).collect()}
    assert one == got


def test_near_duplicates_of_odd_rows(odd):
    got = op5_minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.kept for r in got if r.doc_id is None or r.n_shingles == 0)
    assert op5_minhash.near_duplicates(odd.limit(0)).count() == 0


def brute_removed(rows):
    seen, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        data = (t or "").encode()
        mark = bytearray(len(data))
        for k in range(len(data) - 49):
            piece = data[k:k + 50]
            if seen.setdefault(piece, i) < i:
                mark[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(data, mark) if not m)
        out[i] = (len(data), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_substrings_equal_brute_force(docs, spark, data):
    passage = " ".join(words(30, 3))
    rows = [(i, " ".join(words(40, 200 + i)) + passage[: 40 + i] + " ".join(words(10, 300 + i))) for i in range(12)]
    rows += [(20, passage), (21, passage), (22, "ab" * 200), (23, "ab" * 90), (24, "x" * 49), (25, None), (26, "é" * 70)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(50).collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in op10_suffix.repeated_substrings(docs(rows)).collect()}
    assert got == brute_removed(rows)


def test_repeated_substrings_of_odd_rows(odd):
    got = op10_suffix.repeated_substrings(odd).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got)
    assert op10_suffix.repeated_substrings(odd.limit(0)).count() == 0


@pytest.mark.parametrize("size", [12, 20, 31])
def test_picks_are_the_first_least(size):
    import numpy as np
    codes = np.random.default_rng(size).integers(0, 4, 200).astype(np.uint64) << np.uint64(40)
    got = op10_suffix.picks(codes, size)
    assert got.tolist() == [i + int(codes[i:i + size].argmin()) for i in range(200 - size + 1)]


def test_decontamination_equals_its_sql(spark, data):
    name = "op3_decontaminate"
    assert check(spark, connect(data), data, name, catalog.QUERIES[name], catalog.CHECK_SQL[name]) is None


def test_decontamination_without_broadcast_and_odd_rows(odd, docs, spark):
    items = spark.createDataFrame([(1, "short item"), (2, None), (3, " ".join(words(25, 9))), (3, "!!"), (None, "")],
                                  "item_id long, text string")
    rows = ODD + [(7, "a SHORT, item here"), (8, "zz " + " ".join(words(25, 9)[5:20]) + " zz")]
    for small in (50_000, 0):
        got = op3_decontaminate.contamination(docs(rows), items, small=small)
        found = {r.doc_id: sorted(r["items"]) for r in got.collect() if r["items"]}
        assert found == {7: [1], 8: [3]} and got.count() == len(rows)
    assert op3_decontaminate.report(odd, items.limit(0)).filter("contaminated").count() == 0
    assert op3_decontaminate.report(odd.limit(0), items).count() == 0


def test_passages_are_found_and_clean_texts_left_alone(docs):
    passage = words(80, 5)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[55] = "changed", "edited"
    rows = [(i, " ".join(words(300, 400 + i))) for i in range(8)]
    rows.append((10, " ".join(words(50, 41) + passage + words(50, 42))))
    rows.append((11, " ".join(words(60, 43) + fuzzy + words(20, 44))))
    rows.append((12, " ".join(passage)))
    got = op1_chaining.passages(docs(rows)).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(11, 10), (12, 10)}
    for r in got:
        assert r.end - r.start >= 75 and r.identity >= 0.9


@pytest.mark.parametrize("gap", [20, 31, 60, 100, 150])
def test_passages_on_either_side_of_unshared_words(docs, gap):
    first, second = words(60, 51), words(60, 52)
    rows = [(i, " ".join(words(30, 500 + i) + first + words(gap, 600 + i) + second + words(30, 700 + i)))
            for i in (1, 2)]
    got = sorted((r.start, r.end, r.source_start, r.source_end) for r in op1_chaining.passages(docs(rows)).collect())
    # Up to 30 unshared words leave one passage of identity 0.8.
    ends = [(30, 150 + gap)] if gap <= 30 else [(30, 90), (90 + gap, 150 + gap)]
    assert len(got) == len(ends)
    for (a, b, c, d), (low, high) in zip(got, ends):
        # Words that are equal by chance may lengthen a passage while its identity allows.
        assert a <= low and c <= low and b >= high and d >= high and max(b - a, d - c) <= (high - low) * 1.25 + 5


def test_parts_equal_brute_force():
    import numpy as np
    for seed in range(8):
        r = random.Random(seed)
        x = y = -1
        places = []
        for k in range(160):
            odd = r.random() < (0.1 if k // 40 % 2 else 0.3)
            x, y = x + 1 + odd * r.randrange(3), y + 1 + odd * r.randrange(3)
            places.append((x, y))

        def longest(a, b):
            best = (0, 0, 0)
            for p in range(a, b):
                for q in range(p, b):
                    size = [places[q][s] - places[p][s] + 1 for s in (0, 1)]
                    if min(size) >= 50 and 5 * (q - p + 1) >= 4 * max(size):
                        best = max(best, (q - p + 1, -p, q))
            n, p, q = best[0], -best[1], best[2]
            return [*longest(a, p), (p, q), *longest(q + 1, b)] if n else []

        xs, ys = (np.array(v) for v in zip(*places))
        assert op1_chaining.parts(xs, ys) == longest(0, len(places))


def test_chains_equal_quadratic_programming():
    import numpy as np
    r = random.Random(2)
    points = sorted({(r.randrange(60), r.randrange(60)) for _ in range(50)})
    x, y = (np.array(v) for v in zip(*points))
    score = []
    for j, (a, b) in enumerate(points):
        before = [score[i] - op1_chaining.GAP * (a - p + b - q) for i, (p, q) in enumerate(points[:j]) if p < a and q < b]
        score.append(op1_chaining.MATCH + max([0.0, *before]))
    a, b, c, d, n = op1_chaining.chains(x, y)[0]
    total = n * op1_chaining.MATCH - op1_chaining.GAP * (b - a + d - c)
    assert abs(total - max(score)) < 1e-6


def test_passages_whose_seeds_have_other_sources(docs):
    draw = random.Random(5)
    fill = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    passage = fill(90)
    rows = [(i, " ".join(fill(40) + passage[at:at + 18] + fill(40))) for i, at in enumerate(range(0, 90, 10))]
    rows += [(50, " ".join(fill(30) + passage + fill(30))), (60, " ".join(fill(7) + passage)),
             (70, " ".join(passage[:45])), (71, " ".join(passage[:45]))]
    found = op1_chaining.passages(docs(rows)).collect()
    assert [(r.doc_id, r.source_id, r.start, r.end, r.source_start, r.source_end, r.identity) for r in found] == [
        (60, 50, 7, 97, 30, 120, 1.0)]


def test_picks_leave_no_passage():
    import numpy as np
    r = random.Random(3)
    for n in (49, 50, 80, 130, 300, 400):
        for notice in (0, 20, 39, 49, 60):
            # A stretch that many have among words that few have, some of them none.
            at = r.randrange(n)
            cost = np.array([9 if at <= i < at + notice else r.choice([0, 1, 1, 2, 5, 9]) for i in range(n)])
            left = np.ones(n, bool)
            left[op1_chaining.picks(cost)] = False
            ends = np.flatnonzero(left)
            size, equal = (v[None, :] - v[:, None] + 1 for v in (ends, np.arange(len(ends))))
            assert not ((size >= 50) & (5 * equal >= 4 * size)).any()


def test_documents_that_share_notices_only_are_not_compared(spark, docs, monkeypatch):
    draw = random.Random(8)
    fill = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    head, notice, foot, passage = fill(20), fill(38), fill(20), fill(48)
    plain = lambda: head + fill(24) + foot
    rows = [(i, plain()) for i in range(30)] + [(i, fill(40) + notice + fill(60)) for i in range(30, 50)]
    # The middle shares no seed: every fifth word differs.
    middle = fill(24)
    spoilt = [w if i % 5 else "odd" for i, w in enumerate(middle)]
    rows += [(60, head + middle + foot), (61, head + spoilt + foot), (62, fill(30) + notice + passage[:12]),
             (63, fill(20) + notice + passage[:12] + fill(9))]
    rows = [(i, " ".join(w)) for i, w in rows]
    compared = []
    inner = op1_chaining._unexplained

    def unexplained(*args):
        compared.append(sorted((r.doc_id, r.source) for r in inner(*args).collect()))
        return spark.createDataFrame(compared[0], "doc_id long, source long")

    monkeypatch.setattr(op1_chaining, "_unexplained", unexplained)
    found = {(r.doc_id, r.source_id) for r in op1_chaining.passages(docs(rows)).collect()}
    assert found == {(61, 60), (63, 62)}
    # All pairs of the first thirty alone would be 435; pairs of seeds that few have are compared.
    assert set(compared[0]) >= found and len(compared[0]) <= 30
    monkeypatch.setattr(op1_chaining, "FEW", 10**6)
    compared.clear()
    assert {(r.doc_id, r.source_id) for r in op1_chaining.passages(docs(rows)).collect()} == found
    assert len(compared[0]) > 435


def test_passages_leave_little_on_disk(spark, docs):
    import os
    from urllib.parse import urlparse

    from docloom import session

    folder = urlparse(os.path.dirname(session.shared_folder(spark, "none"))).path
    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(
        "\n").count("shuffle_")
    tables = lambda: {name for name in os.listdir(folder) if name.startswith(("table-", "rdd-"))}
    passage, notice = words(80, 5), words(45, 6)
    rows = [(i, " ".join(words(40, 800 + i) + (passage if i % 2 else notice) + words(40, 900 + i))) for i in range(16)]
    spark._jvm.System.gc()
    before, held = shuffles(), tables()
    found = op1_chaining.passages(docs(rows))
    # What is left is what the result reads; shuffle files do not wait for the driver's garbage collection.
    assert len(tables() - held) <= 3 and shuffles() <= before
    assert {(r.doc_id, r.source_id) for r in found.collect()} >= {(i, 1) for i in range(3, 16, 2)}


def test_rounds_of_chains_give_the_same_passages(docs, monkeypatch):
    rows = [(i, " ".join(words(90, 5) + words(40, 800 + i) + words(70, 6 + i % 3))) for i in range(14)]
    parts = []
    inner = op1_chaining.written
    monkeypatch.setattr(op1_chaining, "written", lambda *dfs: parts.append((len(dfs), dfs[0].columns)) or inner(*dfs))
    plain = lambda: sorted(op1_chaining.passages(docs(rows)).collect())
    found = plain()
    # Nearly all words repeat an earlier text: at most half the words of the corpus lie on the disk at once.
    assert len({r.doc_id for r in found}) == 13
    assert max(n for n, columns in parts if "identity" in columns) >= 3
    monkeypatch.setattr(op1_chaining, "PART", 1e9)
    parts.clear()
    assert plain() == found and {n for n, columns in parts if "identity" in columns} == {1}


def test_only_tables_of_a_job_are_removed(spark, tmp_path):
    from docloom import session

    spark.range(5).write.parquet(str(tmp_path / "input"))
    given, own = spark.read.parquet(str(tmp_path / "input")), session.written(spark.range(7))
    session.remove(given.crossJoin(own.withColumnRenamed("id", "other")))
    assert given.count() == 5
    assert not [f for f in own.inputFiles() if spark._jvm.java.io.File(spark._jvm.java.net.URI(f)).exists()]


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_filter_before_a_shuffle_loses_nothing(spark, monkeypatch, bits):
    from docloom.llm import common
    monkeypatch.setattr(common, "BITS", bits)
    df = spark.range(3000).selectExpr("IF(id % 7 = 0, NULL, id) AS a", "CAST(id % 5 AS string) AS b", "id AS _kept")
    keys = spark.range(0, 3000, 11).selectExpr("id AS a", "CAST(id % 5 AS string) AS b")
    near = common.maybe_in(df, keys.union(keys), "a", "b")
    assert near.columns == df.columns
    same = df.join(keys, ["a", "b"]).count()
    assert same > 100 and near.join(keys, ["a", "b"]).count() == same
    assert near.count() == near.distinct().count() and (bits == 64 or near.count() < same + 20)
    assert common.maybe_in(df, keys.limit(0), "a").count() == 0


def test_seeds_of_many_texts_are_those_of_each():
    import numpy as np
    r = random.Random(1)
    for _ in range(30):
        texts = [np.array([r.randrange(1, r.choice([2, 4, 1000])) for _ in range(r.randrange(50, 120))], np.uint64)
                 for _ in range(r.randrange(1, 5))]
        expected = []
        for t, codes in enumerate(texts):
            total = np.zeros(len(codes) - op1_chaining.SEED + 1, np.uint64)
            for i in range(op1_chaining.SEED):
                total = op5_minhash._mix(total * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + len(total)])
            first = {}
            for j in range(len(total) - op1_chaining.SPAN + 1):
                at = j + int(total[j:j + op1_chaining.SPAN].argmin())
                first[int(total[at])] = min(at, first.get(int(total[at]), at))
            expected += sorted((t, code, place) for code, place in first.items())
        assert list(zip(*(v.tolist() for v in op1_chaining.seeds(texts)))) == expected


def test_passages_of_odd_rows(odd):
    assert op1_chaining.passages(odd.limit(0)).count() == 0
    assert op1_chaining.passages(odd).count() == 0


def test_languages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(1, "https://a.b.example/x", '<html lang="de"><p>der die und nicht</p>'), (2, None, None),
            (None, "nonsense", ""), (1, "https://a.b.example/x", '<html lang="de"><p>der die und nicht</p>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS lang", "2 AS host")
    got = op6_language.identify(pages, docs).collect()
    assert len(got) == 4 and {r.lang for r in got if r.page_id == 1} == {"de"}
    assert op6_language.identify(pages, docs.limit(0)).filter("lang IS NULL").count() == 4
    assert op6_language.identify(pages.limit(0), docs).count() == 0


def brute_languages(rows, model):
    """(lang, confidence) of each (url, html), by the docstring's rule and plain loops."""
    names, weights, unseen = model
    k = len(names)
    norm = lambda v: [x / sum(v) for x in v]
    add = lambda vs: [sum(c) for c in zip(*vs)]
    seen = []
    for url, html in rows:
        text = [op6_language.TEMPER * sum(n * weights.get(p, unseen)[i] for p, n in
                                          op6_language.pairs(op6_language.visible(html)).items()) for i in range(k)]
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = host[1].lower() if host else ""
        said = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html or "", re.I)
        own = norm([math.exp(x - max(text)) for x in text])
        seen.append((text, own, [host, ".".join(host.split(".")[-2:]), host.split(".")[-1]], said and said[1].lower()))
    total = add([s[1] for s in seen])
    out = []
    for text, own, names_, said in seen:
        prior = [(x + 1) / (sum(total) + k) for x in total]
        for level, strength in ((2, op6_language.SUFFIX), (1, op6_language.DOMAIN), (0, op6_language.HOST)):
            rest = [max(a - b, 0) for a, b in zip(add([s[1] for s in seen if s[2][level] == names_[level]]), own)]
            prior = [(c + strength * p) / (sum(rest) + strength) for c, p in zip(rest, prior)]
        logs = [t + math.log(p) for t, p in zip(text, prior)]
        if said:
            rest = [max(a - b, 0) for a, b in zip(add([s[1] for s in seen if s[3] == said]), own)]
            logs = [x + math.log((c + op6_language.DECLARED / k) / (t + op6_language.DECLARED))
                    for x, c, t in zip(logs, rest, total)]
        both = norm([math.exp(x - max(logs)) for x in logs])
        out.append((names[both.index(max(both))], max(both)))
    return out


@pytest.mark.parametrize("share", [3, op6_language.SHARE])
def test_languages_equal_brute_force(spark, share):
    """With hot keys (share 3: a host, domain or suffix of over a third of the rows) and without."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = random.Random(5)
    texts = [t.text[:r.choice((0, 20, 400))] for t in docs.filter("text IS NOT NULL").orderBy("doc_id").limit(90).collect()]
    hosts = ["hot.one.example"] * 6 + ["b.one.example", "c.two.example", "d.three.test", "e.test", "HOT.one.example"]
    rows = [(f"https://{r.choice(hosts)}/{i}", f"<html{r.choice(['', ' lang=de', ' lang=xx'])}><p>{t}")
            for i, t in enumerate(texts)] + [(None, None), ("nonsense", ""), ("https://u@hot.one.example:80/", "<html lang='fr'>")]
    pages = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "page_id long, url string, html string")
    got = {x.page_id: x for x in op6_language.identify(pages, docs, share=share).collect()}
    want = brute_languages(rows, op6_language.fit(docs))
    assert sorted(got) == list(range(len(rows)))
    for i, (lang, confidence) in enumerate(want):
        assert got[i].confidence == pytest.approx(confidence, rel=1e-6)
        assert got[i].lang == lang or want[i][1] < 0.500001


def test_no_language_is_left_out(spark):
    """120 languages, each with letters of its own, are all known and found."""
    word = lambda i: chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i)
    docs = spark.createDataFrame([(i, f"{word(i)} " * 30, f"l{i:03}") for i in range(120)], "doc_id long, text string, lang string")
    pages = docs.selectExpr("doc_id AS page_id", "'https://h.example/' AS url", "text AS html", "lang AS true")
    got = op6_language.identify(pages.drop("true"), docs).join(pages.select("page_id", "true"), "page_id").collect()
    assert len(got) == 120 and all(x.lang == x.true for x in got)


def test_language_accuracy(spark):
    """Documents wrapped as pages without any declaration keep their language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 200")
    pages = docs.selectExpr("doc_id AS page_id", "'https://h.example/' AS url", "concat('<html><p>', text) AS html")
    got = op6_language.identify(pages, docs).join(docs.selectExpr("doc_id AS page_id", "lang AS true"), "page_id").collect()
    assert sum(r.lang == r.true for r in got) >= 0.95 * len(got)


def test_pipeline_stages(spark, data):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontaminate", "pii", "tokens"]
    source = spark.read.parquet(f"{data}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, data).collect()}
    kept = stages["toxicity"](spark, source, data)
    assert kept.columns == source.columns
    parts = brute_components([(r.doc_id, r.text) for r in kept.collect()], corpus_pipeline.PERCENT)
    firsts = {i for i, (_, c) in parts.items() if i == c}
    hit = {r.doc_id for r in op3_decontaminate.op3_decontaminate(spark, data).filter("contaminated").collect()}
    assert out == firsts - hit


def test_every_query_is_registered_once():
    numbers = collections.Counter(re.match(r"op(\d+)_", n)[1] for n in catalog.QUERIES)
    assert numbers == {str(n): 1 for n in range(1, 14)}


def test_pipeline_links_copies_of_four_fifths(docs, spark):
    rows = []
    for i in range(12):
        text = words(200, 900 + i)
        rows.append((i, " ".join(text)))
        for k in range(3 + i % 3):  # 3, 4 or 5 edits: similarity 0.86, 0.81 or 0.77
            text[20 + 40 * k % 180] = f"edit{i}x{k}"
        rows.append((100 + i, " ".join(text)))
    want = {i for i, (_, c) in brute_components(rows, 80).items() if i == c}
    assert len(want) == 16
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs(rows), "")
    assert {r.doc_id for r in got.collect()} == want


def test_repeated_substrings_when_splits_change_between_jobs(docs, spark, monkeypatch, tmp_path):
    passage = " ".join(words(30, 3))
    rows = [(i, " ".join(words(40 + i, 200 + i)) + passage) for i in range(24)] + [(30, "é" * 70)] * 3
    docs(rows).select("doc_id", "text").repartition(12).write.parquet(str(tmp_path / "d"))
    key, turn, real = "spark.sql.files.openCostInBytes", [0], op10_suffix.durable
    before = spark.conf.get(key)

    def other_splits(df):
        out = real(df)
        turn[0] += 1
        spark.conf.set(key, str(1 << (27 if turn[0] % 2 else 10)))
        return out

    monkeypatch.setattr(op10_suffix, "durable", other_splits)
    spark.conf.set(key, "1024")
    try:
        got = op10_suffix.repeated_substrings(spark.read.parquet(str(tmp_path / "d"))).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_removed(rows)
