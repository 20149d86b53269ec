"""Each operator against brute force or an exact round trip, and the cases that its docstring defines."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtide.llm import common, decontam, langid, lm, media, mixing, neardup, sharding, suffixes, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, shard string"
WORD = re.compile(r"[^\W_]+")
VOCAB = {"en": "the of and that with stone river winter market light carry over under road house green field table paper small".split(), "de": "der die und nicht über straße wasser fenster könig schule garten brücke löffel tür stühle wäsche".split()}


def words(rng, n, lang="en"):
    return [rng.choice(VOCAB[lang]) + rng.choice(["", "s", "er", "ing", "est", "ly", "ed"]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Ordinary documents, exact and near copies, a repeated passage, a benchmark passage, nulls, blanks, repeated rows and a long text."""
    rng = random.Random(7)
    out = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        out.append([i, " ".join(words(rng, rng.randint(60, 200), lang)) + ".", lang, f"src{i % 4}"])
    out[10][1] = out[8][1]
    near = out[8][1].split()
    near[40] = "changed"
    out[11][1] = " ".join(near)
    passage = " ".join(words(rng, 70))
    for i in (20, 22, 25):
        out[i][1] = " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30))
    out += [[60, None, "en", "src1"], [61, "", None, None], [62, "12 34 !!", "en", None], [63, "word", "en", "src0"], [64, "word", "en", "src0"], [64, "word", "en", "src0"], [None, "no id here at all in this row", "en", "src2"]]
    out.append([65, " ".join(words(rng, 20_000)), "en", "src0"])
    return [(a, b, c, d, len(b or ""), "x", "y") for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(text):
    w = WORD.findall((text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


# op1


def test_flow_moves_the_fewest():
    flow = sharding.min_cost_flow({0: 10, 1: 2, 2: 6}, [6, 6, 6])
    assert flow == {(0, 0): 6, (0, 1): 4, (1, 1): 2, (2, 2): 6}
    with pytest.raises(ValueError):
        sharding.min_cost_flow({0: 5}, [4])


def test_flow_against_all_choices():
    """Integer flows of few units, all of them tried."""
    rng = random.Random(1)
    for _ in range(30):
        old = {i: rng.randint(0, 2) for i in rng.sample(range(6), 3)}
        room = [sum(old.values()) // 3 + rng.randint(1, 2) for _ in range(3)]
        flow = sharding.min_cost_flow(old, room)
        units = [i for i, n in old.items() for _ in range(n)]
        moved = [sum(i != j for i, j in zip(units, to)) for to in itertools.product(range(3), repeat=len(units)) if all(to.count(j) <= room[j] for j in range(3))]
        assert sum(n for (i, j), n in flow.items() if i != j) == min(moved)
        assert all(sum(n for (i, _), n in flow.items() if i == k) == n for k, n in old.items()) and all(sum(n for (_, j), n in flow.items() if j == k) <= r for k, r in enumerate(room))


def test_cheapest_flow_with_prices():
    """A detour that a later path must take back."""
    edges = [(0, 1, 1, 1), (0, 2, 1, 4), (1, 2, 1, 1), (1, 3, 1, 5), (2, 3, 1, 1)]
    assert sharding.cheapest_flow(4, edges, 0, 3, 2) == [1, 1, 0, 1, 1]
    assert sharding.cheapest_flow(4, edges, 0, 3, 1) == [1, 0, 1, 0, 1]


def test_flow_of_many_shards():
    rng = random.Random(5)
    old = {i: rng.randint(0, 10**12) for i in range(4_000)}
    share = sum(old.values()) // 5_000 + 1
    flow = sharding.min_cost_flow(old, [share] * 5_000)
    assert sum(n for (i, j), n in flow.items() if i == j) == sum(min(n, share) for n in old.values()) and len(flow) < 4_000 + 5_000 + 4_000


def resharded(docs, new):
    r = sharding.keyed(docs, sharding.landed_shard(), sharding.size_of(), ("doc_id", "text"))
    layout = sharding.plan(r, new)
    out = sharding.with_slots(sharding.rewrite(r, layout, docs.columns)).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for x in out:
        sizes[x.shard] += len((x.text or "").encode()) + 1
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and layout.total == sum(sizes.values())
    return out, sizes, layout


def test_resharding(spark, docs, rows):
    out, sizes, _ = resharded(docs, 3)
    assert sorted((x.doc_id or -1, x.text or "") for x in out) == sorted((a or -1, b or "") for a, b, *_ in rows)
    biggest = max(len((b or "").encode()) for _, b, *_ in rows)
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) <= 2 * biggest


def test_resharding_cuts_between_rows_alike(spark):
    """Many rows alike with and without an id: every shard has its share, up to a row at each end."""
    for many in (5, None):
        given = [(many, "x" * 431, "a")] * 400 + [(i, "y" * 3, f"s{i % 5}") for i in range(100)]
        df = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(3)
        out, sizes, _ = resharded(df, 8)
        share = (400 * 432 + 100 * 4) / 8
        assert len(out) == 500 and set(sizes) == set(range(8)) and all(abs(n - share) <= 2 * 432 for n in sizes.values()), sizes


def test_only_affected_blocks_are_written(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"s{i % 40}") for i in range(3_000)], "doc_id long, text string, source string")
    r = sharding.keyed(df, sharding.landed_shard(), sharding.size_of(), ("doc_id", "text"))
    layout = sharding.plan(r, 8)
    placed = layout.placed(r)
    assert placed.where(f"{sharding.STAYS} and shard <> {sharding.WAS}").isEmpty()
    moved = placed.where(f"shard <> {sharding.WAS}").agg(F.sum(sharding.SIZE)).first()[0]
    assert abs(moved - layout.moved) <= 20 * 12 and moved < layout.total
    written = placed.where(f"not {sharding.STAYS}").agg(F.sum(sharding.SIZE)).first()[0]
    assert moved <= written < layout.total


def test_resharding_of_nothing_and_of_columns_named_alike(spark, docs, empty):
    assert resharded(empty, 8)[0] == []
    names = ["_n", "_base", "_r", "_hash", "_block", "_size", "size", "n", "first", "a.b", "slot"]
    alike = docs.withColumns({c: F.lit(c) for c in names})
    r = sharding.keyed(alike, sharding.landed_shard(), sharding.size_of(), ("doc_id", "text"))
    out = sharding.with_slots(sharding.rewrite(r, sharding.plan(r, 3), alike.columns))
    assert {tuple(x) for x in out.select([f"`{c}`" for c in names[:-1]]).collect()} == {tuple(names[:-1])}
    assert out.count() == docs.count()


# op2


def test_language_models(spark, docs, empty):
    good = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")  # the German ones
    flagged = lm.flagged(docs, good)
    models = lm.learn(flagged)
    out = {r.doc_id: r for r in lm.score(flagged, models).collect()}
    assert out[60].n_tokens == 0 and out[60].score is None and out[61].target_loss is None
    german = [out[i].score for i in range(0, 60, 3) if i not in (8, 10, 11)]
    english = [out[i].score for i in range(1, 60) if i % 3 and i not in (20, 22, 25)]
    assert max(german) < min(english)
    texts = {a: b for a, b, *_ in [tuple(r) for r in docs.select("doc_id", "text").collect()]}
    assert out[5].n_tokens == len(WORD.findall(texts[5]))
    nothing = lm.flagged(empty, good)
    assert lm.score(nothing, lm.learn(nothing)).count() == 0


def test_loss_by_hand(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a c")], "doc_id long, text string")
    flagged = lm.flagged(df, spark.createDataFrame([(2,)], "doc_id long"))
    m = lm.learn(flagged)
    got = {r.doc_id: r for r in lm.score(flagged, m).collect()}
    scale, size = 2 / 5, 4
    # document 1 under the target model: c(a)=1, c(b)=0, two words, unseen pairs
    p = lambda n: (n + lm.ADD) / (2 + lm.ADD * size)
    own = lambda w, h: lm.PRIOR * p(w) / (h + lm.PRIOR)
    want = -(np.log(p(1)) + np.log(own(0, 1)) + np.log(own(1, 0))) / 3
    assert abs(got[1].target_loss - want) < 1e-9 and m.scale == scale


def test_losses_against_plain_counts_over_many_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_CHARS", 2_000)
    good = set(range(0, 60, 3))
    flagged = lm.flagged(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"))
    m = lm.learn(flagged)
    assert m.chunks.count() > 20
    given = [(r.doc_id, WORD.findall((r.text or "").lower())) for r in docs.collect()]
    count = lambda chosen, k: collections.Counter(x for _, w in chosen for x in zip(*(w[i:] for i in range(k))))
    both = [([count(c, 1), count(c, 2)], scale) for c, scale in ((given, m.scale), ([x for x in given if x[0] in good], 1.0))]
    size = len(both[0][0][0]) + 1

    def loss(d, w, model):
        (one, two), scale = both[model]
        own, own2 = ((count([(d, w)], k) if model == 0 or d in good else collections.Counter()) for k in (1, 2))
        c = lambda table, mine, x: (table[x] - mine[x]) * scale
        total, out = (sum(one.values()) - sum(own.values())) * scale, 0.0
        for i, x in enumerate(w):
            p = (c(one, own, (x,)) + lm.ADD) / (total + lm.ADD * size)
            if i:
                pair = c(two, own2, (w[i - 1], x))
                p = (pair + lm.PRIOR * p) / (max(c(one, own, (w[i - 1],)), pair) + lm.PRIOR)
            out -= np.log(p)
        return out / len(w)

    want = sorted((str(d), len(w), *(loss(d, w, k) for k in (1, 0))) for d, w in given if w)
    got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in lm.score(flagged, m).collect() if r.n_tokens)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2:] for x in got], [x[2:] for x in want], atol=1e-9)


def test_every_word_and_bigram_counts(spark):
    n = 200_000
    text = " ".join(f"w{i}" for i in range(n))
    flagged = lm.flagged(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long"))
    m = lm.learn(flagged)
    got = {r.doc_id: r for r in lm.score(flagged, m).collect()}
    p = (1 + lm.ADD) / (n + lm.ADD * (n + 1))  # of document 1 under the target model: each word and bigram once
    want = -(np.log(p) + (n - 1) * np.log((1 + lm.PRIOR * p) / (1 + lm.PRIOR))) / n
    assert abs(got[1].target_loss - want) < 1e-9


# op3


def covered(texts, n=suffixes.PASSAGE):
    w = {k: WORD.findall((t or "").lower()) for k, t in texts.items()}
    seen = collections.Counter(tuple(x[i : i + n]) for x in w.values() for i in range(len(x) - n + 1))
    return {(k, i) for k, x in w.items() for i in range(len(x) - n + 1) if seen[tuple(x[i : i + n])] > 1}


def test_repeated_passages(spark, rows, docs, empty):
    more = [(i, " ".join(words(random.Random(i // 3), 120)), "en", "s", 0, "x", "y") for i in (300, 300, 300, 301)] + [(None, " ".join(words(random.Random(77), 80)), "en", "s", 0, "x", "y")] * 3
    both = docs.unionByName(spark.createDataFrame(more, DOCS)).withColumns({c: F.lit(c) for c in ("core", "pos", "at", "a.b")})
    given = [(r.doc_id, r.text) for r in both.collect()]
    want = collections.Counter((given[k][0], i) for k, i in covered(dict(enumerate(t for _, t in given))))
    found = suffixes.repeated_passages(both).collect()
    got = collections.Counter((r.doc_id, i) for r in found for i in range(r.start_word, r.end_word - suffixes.PASSAGE + 1))
    assert want and got == want and want[300, 0] == 3 and want[None, 0] == 3
    assert suffixes.repeated_passages(empty).count() == 0


def test_adjoining_passages_of_different_documents(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts, k = {}, 0
    for _ in range(30):
        a, b, whole = fresh(40), fresh(40), fresh(60)
        for w in (fresh(20) + a + b + fresh(20), fresh(20) + a + fresh(30), fresh(20) + b + fresh(30), fresh(9) + whole + b + fresh(9), whole + fresh(5)):
            texts[k] = " ".join(w)
            k += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, i) for r in suffixes.repeated_passages(df).collect() for i in range(r.start_word, r.end_word - suffixes.PASSAGE + 1)}
    assert got == covered(texts)


def test_hot_passage_over_many_partitions(spark):
    rng = random.Random(3)
    passage = words(rng, 60)
    texts = {i: " ".join(words(rng, rng.randint(0, 40)) + passage + words(rng, rng.randint(0, 40))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r.doc_id: (r.start_word, r.end_word) for r in suffixes.repeated_passages(df).collect()}
    for i, t in texts.items():
        at = " ".join(WORD.findall(t)).split().index(passage[0])
        assert spans[i][0] <= at + 40 and spans[i][1] - spans[i][0] >= 60


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 50, 2000, dtype=np.uint64)
    first = np.array([0, 700, 703, 2000])
    at = set(suffixes.minimisers(w, first).tolist())
    for a, b in zip(first, first[1:]):
        for s in range(a, b - suffixes.WINDOW - suffixes.GRAM + 2):
            assert any(p in at for p in range(s, s + suffixes.WINDOW))


# op4


def test_language(spark, docs, empty):
    model = langid.learn(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    out = {r.doc_id: r for r in langid.label(docs, model).collect() if r.doc_id is not None}
    assert [(out[k].lang_pred, out[k].score) for k in (60, 61, 62)] == [("und", 0.0)] * 3
    truth = {i: "de" if i % 3 == 0 else "en" for i in range(60) if i not in (10, 11, 20, 22, 25)}
    assert sum(out[i].lang_pred == t for i, t in truth.items()) >= len(truth) - 1
    rng = random.Random(5)
    mixed = spark.createDataFrame([(1, " ".join(words(rng, 40, "en") + words(rng, 40, "de")))], "doc_id long, text string")
    assert [s.lang for s in langid.label(mixed, model).first().spans] == ["en", "de"]
    blank = langid.learn(empty.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.label(docs, blank).collect()} == {"und"}
    assert langid.label(empty, model).count() == 0


def test_no_language_is_lost_by_the_bound(spark):
    rng = random.Random(8)
    some = [(i, " ".join(words(rng, 8)), "en") for i in range(3_000)] + [(9_000 + i, " ".join(words(rng, 8, "de")), "de") for i in range(3)]
    for ids in (True, False):
        df = spark.createDataFrame([(i if ids else None, t, x) for i, t, x in some], "doc_id long, text string, lang string")
        assert langid.learn(df, rows=500).langs == ["de", "en"]
        n = collections.Counter(r.lang for r in langid.chosen(df, 500, "doc_id").collect())
        assert n["de"] == 3 and 400 <= n["en"] <= 600
    alike = spark.createDataFrame([(None, "the same text", "en")] * 2_000 + [(None, "der gleiche text", "de")] * 2_000, "doc_id long, text string, lang string")
    assert langid.learn(alike, rows=50).langs == ["de", "en"] and langid.chosen(alike, 50, "doc_id").count() <= 4
    assert langid.parts_of({"a": 3, "b": 1_000, "c": 10, "d": 90}, 100) == {"a": 3, "c": 10, "d": 43, "b": 44}


def test_word_scores_against_plain_counts(spark):
    """Log-likelihoods of words from plain trigram counts, and the language of most letters of the best path."""
    rng = random.Random(31)
    texts = [(3 * i + 2, " ".join(words(rng, 30, x)), x) for i, x in enumerate(["en", "de"] * 6)]
    model = langid.learn(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    grams = lambda w: [f"\0{w}\0"[i : i + 3] for i in range(len(w))]
    counts = {x: collections.Counter(g for _, t, y in texts if x == y for w in t.split() for g in grams(w)) for x in ("de", "en")}
    kinds = len(set(counts["de"]) | set(counts["en"]))
    given = " ".join(words(rng, 25, "en") + words(rng, 20, "de") + words(rng, 9, "en"))
    logp = lambda w, x: sum(np.log((counts[x][g] + langid.SMOOTHING) / (sum(counts[x].values()) + langid.SMOOTHING * kinds)) for g in grams(w))
    bucket, begin, *_ = langid._trigrams(pa.array([given], pa.large_string()))
    got = np.add.reduceat(model.logp[bucket], begin, axis=0)
    want = np.array([[logp(w, x) for x in ("de", "en")] for w in given.split()])
    assert (np.abs(got - want) < 1e-2).mean() > 0.9 and np.abs(got - want).max() < 3  # a few trigrams share a bucket
    best, path = {0: (want[0][0], [0]), 1: (want[0][1], [1])}, None
    for w in want[1:]:
        best = {k: max((s - (langid.SWITCH if j != k else 0) + w[k], [*p, k]) for j, (s, p) in best.items()) for k in (0, 1)}
    path = max(best.values())[1]
    held = [sum(len(w) for w, k in zip(given.split(), path) if k == x) for x in (0, 1)]
    row = langid.label(spark.createDataFrame([(1, given)], "doc_id long, text string"), model).first()
    assert row.lang_pred == ("de", "en")[held[1] >= held[0]] and abs(row.score - max(held) / sum(held)) < 1e-9


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    doc = np.array([0] * 5 + [2] * 3 + [3])
    s = rng.normal(size=(9, 3)).astype(np.float32) * 4
    got = langid.viterbi(s, doc, 4, 3.0)
    for d in (0, 2, 3):
        own = s[doc == d]
        score = lambda p, o=own: sum(o[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=len(own)), key=score)
        assert abs(score(best) - score(got[doc == d])) < 1e-4


# op5


def test_urls(spark):
    given = ["http://a.b.Example.ORG/es/x?q", "https://example.org/en/12", "https://org/", "http://notexample.org/es/", "https://x.com/fr/", "https://com/de/1#z", "ftp://x.net/fr/", "nothing", None, "http://fr.com", "http://x.com/de", "http://a..org/"]
    df = spark.createDataFrame([(i, u, "e") for i, u in enumerate(given)], "page_id long, url string, extra string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        return host, path, rule, verdict

    want = [(i, *plain(u)) for i, u in enumerate(given)]
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == want
    old, urls.MAX_RULE_BYTES = urls.MAX_RULE_BYTES, 100
    try:
        assert sorted(map(tuple, urls.judge(df, rules).collect())) == want  # in several sweeps
    finally:
        urls.MAX_RULE_BYTES = old
    assert urls.judge(df.where("false"), rules).count() == 0


def test_many_nested_rules(spark, monkeypatch):
    rng = random.Random(17)
    hosts = ["org", "a.org", "b.a.org", "com", "x.com", "aorg", "a"]
    part = lambda: "".join(rng.choice("ab/") for _ in range(rng.randint(0, 6)))
    rules = sorted({(rng.choice(hosts), "/" + part(), rng.choice(["allow", "block"])) for _ in range(300)})
    given = [(i, f"http://{rng.choice(['', 'c.', 'a.'])}{rng.choice(hosts)}/{part()}{part()}") for i in range(2_000)]

    def plain(u):
        host, path = u[7:].split("/", 1)
        path = "/" + path
        fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, "allow")

    pages, table = spark.createDataFrame(given, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (32 << 20, 5_000):
        monkeypatch.setattr(urls, "MAX_RULE_BYTES", most)
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, table).collect()} == {i: plain(u) for i, u in given}


# op6


def test_mix(spark, docs, rows, empty):
    out = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(mixing.WORDS, t or ""))
    assert sorted(r.size for r in out) == sorted(count(b) for _, b, *_ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    size = collections.Counter()
    for _, b, _, s, *_ in rows:
        size[s] += count(b)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = collections.Counter()
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= max(5, 0.02 * t) for s, t in target.items())
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix(empty).count() == 0 and {r.taken for r in mixing.mix(docs.where("doc_id in (60, 61)")).collect()} == {0}


def test_seats_are_sainte_lague(spark):
    s = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate([50, 700, 3000, 12_000, 90_000])], "source string, source_size long")
    rows = mixing.seats(mixing.targets(s)).collect()
    seats = sorted(((-r.target / (2 * j + 1), r["rank"]) for r in rows for j in range(int(2 * r.target * r.all_seats / r.total) + 3)))[: rows[0].all_seats]
    assert {r["rank"]: r.seats for r in rows} == {r["rank"]: sum(k == r["rank"] for _, k in seats) for r in rows}


def test_small_source_beside_a_very_large_total(spark):
    s = spark.createDataFrame([("a", 3_000_000_000), ("b", 1_000), ("c", 2_000_000_000), ("d", 700)], "source string, source_size long")
    for r in mixing.seats(mixing.targets(s)).collect():
        assert abs(r.seats * r.block - r.target) <= max(0.01 * r.target, r.block), r


def test_ten_small_documents_in_a_mix_of_many_blocks(spark):
    docs = [(i, "word " * 10, "small") for i in range(10)] + [(100 + i, "word " * 20_000, f"big{i % 2}") for i in range(24)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(df).collect()
    taken, target = collections.Counter(), {r.source: r.target for r in out}
    for r in out:
        taken[r.source] += r.taken
    assert all(abs(taken[k] - t) <= max(2, 0.01 * t) for k, t in target.items()), (taken, target)


# op7


def test_near_duplicates(spark, docs, rows, empty):
    got = collections.defaultdict(set)
    for r in neardup.near_duplicates(docs).collect():
        got[r.class_id].add(r.doc_id)
    assert {8, 10, 11} in got.values() and {63, 64} in got.values()
    bags = {a: bag(b) for a, b, *_ in rows if a is not None}
    for ids in got.values():
        for x in ids - {None}:
            for y in bags:
                both = sum((bags[x] & bags[y]).values())
                if bags[x] and bags[y] and both >= 0.8 * (sum(bags[x].values()) + sum(bags[y].values()) - both):
                    assert y in ids
    assert neardup.near_duplicates(empty).count() == 0


def test_large_loose_group(spark, monkeypatch):
    """Chains of edits: links exist between some members only, in buckets larger than SMALL."""
    rng = random.Random(4)
    base = words(rng, 150)
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    bags, parent = {k: bag(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in texts:
        for y in texts:
            both = sum((bags[x] & bags[y]).values())
            if x < y and both / (sum(bags[x].values()) + sum(bags[y].values()) - both) >= 0.8:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    assert got == {k: root(k) for k in texts}


def test_recall_by_similarity(spark):
    """Pairs of random texts of which a part of the words differ: those of similarity 0.8 and more share a class, in at least 99 of 100 cases."""
    rng, texts = random.Random(23), {}
    for k in range(300):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        changed = list(base)
        for at in rng.sample(range(120), rng.randint(1, 4)):
            changed[at] = "z"
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(changed)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    near = 0
    for k in range(300):
        a, b = bag(texts[2 * k]), bag(texts[2 * k + 1])
        both = sum((a & b).values())
        if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
            near += got[2 * k] == got[2 * k + 1]
        else:
            assert got[2 * k] != got[2 * k + 1]
    wanted = sum(sum((bag(texts[2 * k]) & bag(texts[2 * k + 1])).values()) * 1.8 >= 0.8 * 2 * 116 for k in range(300))
    assert near >= 0.99 * wanted > 100


def test_two_loose_groups_in_shared_buckets(spark, monkeypatch):
    """A template with many fillings: most pairs are below the similarity, and blocks must find the others, of any bytes."""
    rng, texts = random.Random(6), {}
    template = words(rng, 200)
    for i in range(90):
        w = list(template)
        at = rng.randrange(160)
        w[at : at + 25] = [f"f{rng.randrange(6)}x{j}" for j in range(25)] if i % 3 else [f"g{i // 9}x{j}" for j in range(25)]
        texts[i] = " ".join(w)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SMALL", 4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    bags, parent = {k: bag(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(texts, 2):
        both = sum((bags[x] & bags[y]).values())
        if both >= 0.8 * (sum(bags[x].values()) + sum(bags[y].values()) - both):
            parent[max(root(x), root(y))] = min(root(x), root(y))
    assert got == {k: root(k) for k in texts}


def test_repeated_rows_keep_one(spark):
    text = " ".join(words(random.Random(2), 40))
    df = spark.createDataFrame([(5, text, "k")] * 3 + [(None, "", "k")] * 2 + [(None, text + " more", "k"), (7, None, "k")], "doc_id long, text string, `node.x` string")
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == 7 and sum(r.keep for r in rows if r.class_key) == 1 and sum(r.keep for r in rows if not r.class_key) == 3
    assert {r.class_id for r in rows if r.class_key} <= {5, None} and len({r.class_key for r in rows if r.class_key}) == 1


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**44, 40, dtype=np.uint64)
    a, b = rng.integers(1, 30, 40), rng.integers(1, 30, 40)
    sig = neardup.bag_minhash(np.repeat([0, 1], 40), np.concatenate([e, e]), np.concatenate([a, b]), 2, m=4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# op8


def test_media_round_trip(docs, rows, empty):
    out = {r.doc_id: r for r in media.read_avi(media.to_avi(docs)).collect() if r.doc_id is not None}
    for a, b, *_ in rows:
        if a is None:
            continue
        raw = (b or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = out[a]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert sum(c.frames for c in r.clips) == len(payload) // 576
    clips = media.clip_rows(media.to_avi(docs.where("doc_id = 65"))).collect()
    assert [(c.doc_id, c.first_frame, c.frames, c.start_ms, c.end_ms) for c in clips] == [(65, c.first_frame, c.frames, c.start_ms, c.end_ms) for c in out[65].clips] and clips[-1].end_ms == round(out[65].payload_bytes // 576 * 1000 / media.FPS)
    assert (out[63].media_sha256, out[63].feature) == (out[64].media_sha256, out[64].feature)
    assert media.read_avi(media.to_avi(empty)).count() == 0


def bit_by_bit(jpeg):
    """A lossless one-component JPEG, decoded a bit at a time."""
    at, codes = 2, {}
    while True:
        marker, n = int.from_bytes(jpeg[at : at + 2]), int.from_bytes(jpeg[at + 2 : at + 4])
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFFC3:
            height, width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
        elif marker == 0xFFC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[f"{code:0{length}b}"] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xFFDA:
            break
    assert not any(set(c) == {"1"} for c in codes)
    bits = "".join(f"{x:08b}" for x in jpeg[at:-2].replace(b"\xff\0", b"\xff"))
    out, p = np.zeros((height, width), int), 0
    for y in range(height):
        for x in range(width):
            word = ""
            while word not in codes:
                word, p = word + bits[p], p + 1
            c = codes[word]
            v = int(bits[p : p + c] or "0", 2)
            p += c
            out[y, x] = (v if v >> (c - 1) else v - (1 << c) + 1) if c else 0
            out[y, x] += out[y, x - 1] if x else out[y - 1, x] if y else 128
    assert set(bits[p:]) <= {"1"} and len(bits) - p < 8
    return out


def test_frames_against_a_bit_by_bit_decoder():
    rng = np.random.default_rng(0)
    for px in (rng.integers(0, 256, (4, 24, 24)), np.full((3, 24, 24), 128), rng.integers(90, 99, (5, 7, 10)), rng.choice([0, 255], (2, 3, 5)), np.zeros((1, 1, 1))):
        px = px.astype(np.uint8)
        jpegs = media.encode(px, np.array([0, 1, len(px)]) if len(px) > 1 else np.array([0, 1]))
        assert all(np.array_equal(bit_by_bit(j), p) for j, p in zip(jpegs, px))
        got, height, width = media.decode(jpegs)
        assert (height, width) == px.shape[1:] and np.array_equal(got.reshape(px.shape), px)


def test_code_lengths_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        counts = tuple(rng.choice([0, 1, 2, 5, 40, 300]) for _ in range(5))
        used = [n for n in counts if n]
        lengths = media.code_lengths(counts)
        assert [n > 0 for n in counts] == [x > 0 for x in lengths] and sum(2.0**-x for x in lengths if x) < 1 or not used
        if used:  # the best of all prefix codes that leave a word free
            best = min(sum(n * x for n, x in zip(used, xs)) for xs in itertools.product(range(1, 6), repeat=len(used)) if sum(2.0**-x for x in xs) < 1)
            assert sum(n * x for n, x in zip(counts, lengths)) == best


def test_files_of_one_batch_keep_their_rate_and_size():
    def file(px, fps):
        px = np.asarray(px, np.uint8)
        return media.avi(media.encode(px, np.array([0, len(px)])), px.shape[2], px.shape[1], fps)

    shot = np.repeat([20] * 6 + [200] * 6, 8 * 6).reshape(12, 8, 6)
    one, two, three = media._described([file(shot, 10), file(shot[:, :4, :4], 50), file(shot, 30)])
    times = lambda row: [(c["first_frame"], c["frames"], c["start_ms"], c["end_ms"], c["mean_luma"]) for c in row[-1]]
    assert times(one) == [(0, 6, 0, 600, 20.0), (6, 6, 600, 1200, 200.0)]
    assert times(two) == [(0, 6, 0, 120, 20.0), (6, 6, 120, 240, 200.0)]
    assert times(three)[1] == (6, 6, 200, 400, 200.0) and (one[0], two[0]) == (12 * 48, 12 * 16)
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF....WAVE")


def test_shots_against_plain_sums():
    rng = np.random.default_rng(5)
    hist = rng.multinomial(576, rng.dirichlet(np.ones(16)), 60)
    hist[30:] = hist[30:, ::-1]
    doc = np.repeat([0, 1, 2], [25, 30, 5])
    cut, diff = media.shots(hist, doc)
    for i in range(60):
        own = [j for j in range(i) if doc[j] == doc[i]]
        d = [int(np.abs(hist[j] - hist[j - 1]).sum()) for j in own if j - 1 in own][-media.WINDOW :]
        now = int(np.abs(hist[i] - hist[i - 1]).sum()) if own else 0
        assert diff[i] == now and cut[i] == (bool(own) and now > (np.mean(d) + media.DEVIATIONS * np.std(d) if d else 0) and now > 2 * 576 * media.FLOOR)


# op9


def test_tokens(docs, rows, empty):
    encoding, lengths = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN)
    out = {r.doc_id: r for r in tokens.attribute(docs).collect() if r.doc_id is not None}
    for a, b, lang, src, *_ in rows:
        if a is None:
            continue
        whole = "\n".join([src or "", lang or "", b or ""])
        starts = [0, len((src or "").encode()) + 1]
        starts.append(starts[1] + len((lang or "").encode()) + 1)
        starts += [starts[2] + m.end() for m in re.finditer(b"\n", (b or "").encode())]
        at, n = 0, [0] * len(starts)
        for t in encoding.encode_ordinary(whole):
            held = [min(at + lengths[t], (starts + [10**9])[k + 1]) - max(at, starts[k]) for k in range(len(starts))]
            n[held.index(max(held))] += 1
            at += lengths[t]
        r = out[a]
        assert (list(r.field_tokens), list(r.line_tokens), r.n_tokens) == (n[:2], n[2:], sum(n))
    assert tokens.attribute(empty).count() == 0


def test_crossing_tokens():
    ends, sections = np.array([4, 9, 12]), np.array([0, 6, 10, 11])
    assert tokens.allocate(ends, sections)[0].tolist() == [0, 1, 1]
    assert tokens.allocate(ends, sections, "start")[0].tolist() == [0, 0, 1]
    assert tokens.allocate(ends, sections)[1].tolist() == [False, True, True]


# op10


def distance(a, b):
    """Fewest edits that turn a into a stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(9)
    item, other = " ".join(words(rng, 40)), " ".join(words(rng, 40))
    hit = list(item)
    for at in rng.sample(range(len(hit)), 6):
        hit[at] = "q"
    extra = [(200, "Before. " + item.upper() + "! After.", "en", "s", 0, "x", "y"), (201, "Some " + "".join(hit) + " more", "en", "s", 0, "x", "y"), (202, " ".join(words(rng, 30)) + " " + item[: len(item) * 2 // 3], "en", "s", 0, "x", "y")]
    both = docs.unionByName(spark.createDataFrame(extra, DOCS))
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "short one")], "item_id long, text string")
    found = decontam.find(both, items).collect()
    assert {(r.key, r.item_id) for r in found} == {(200, 1), (201, 1), (202, 1)}
    assert next(r.edits for r in found if r.key == 200) == 0
    kept = decontam.clean_only(both, items)
    assert kept.columns == both.columns and kept.count() == len(rows) and not kept.where("doc_id >= 200").count()
    old, decontam.MAX_ITEM_BYTES = decontam.MAX_ITEM_BYTES, 200
    try:
        assert {(r.key, r.item_id) for r in decontam.find(both, items).collect()} == {(200, 1), (201, 1), (202, 1)}
    finally:
        decontam.MAX_ITEM_BYTES = old
    assert decontam.find(empty, items).count() == 0 and decontam.find(docs, items.where("false")).count() == 0


def test_excerpts_at_every_offset():
    rng = random.Random(12)
    item = " ".join(words(rng, 60))
    ix, texts = decontam.index([(1, item)]), []
    for n in (80, 100, 119, 120, 121, 150, 170):
        for at in range(len(item) - n + 1):
            texts.append(" ".join(words(rng, 12)) + " " + item[at : at + n] + " " + " ".join(words(rng, 12)))
    own, starts, _ = decontam.reduced(pa.array(texts, pa.large_string()))
    assert {t for t, *_ in decontam.matches(own, starts, ix)} == set(range(len(texts)))
    others = pa.array([" ".join(words(rng, 60)) for _ in range(300)], pa.large_string())
    assert not list(decontam.matches(*decontam.reduced(others)[:2], ix))


def test_short_items_match_as_whole_words(spark):
    items = [(1, "What is the capital of Peru?"), (2, "of Peru"), (3, "a b c d"), (4, "photosynthesis")]
    texts = [(1, "So: what IS the capital of  Peru, they asked"), (2, "what is the capital of Perus"), (3, "what is the capitol of peru"), (4, "photosynthesis a b c d of Peru"), (5, "What is the capital of Peru")]
    found = decontam.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.key, r.item_id, r.edits) for r in found} == {(1, 1, 0), (5, 1, 0)}
    assert [(r.start, r.end) for r in found if r.key == 1] == [(4, 32)]


def test_filter_against_full_alignment():
    """Pieces with up to their budget of random edits, and random texts: what full alignment finds, the filter finds, and nothing else."""
    rng = random.Random(40)
    item = "".join(rng.choice("abcdefgh ") for _ in range(60)).strip().replace("  ", " x")[:56]
    ix = decontam.index([(1, item)])
    plain = "".join(chr(c) for c in ix.piece_text[0])
    assert len(ix.need) == 1
    texts = []
    for _ in range(200):
        own = list(plain)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(own))
            own[at] = rng.choice(["", rng.choice("abcdefgh"), own[at] + rng.choice("abcdefgh")])
        fill = lambda: "".join(rng.choice("ijklm") for _ in range(rng.randint(0, 30)))
        texts.append((fill() + "".join(own) + fill()))
    own, starts, _ = decontam.reduced(pa.array(texts, pa.large_string()))
    reduced = ["".join(chr(c) for c in own[a:b]) for a, b in zip(starts, starts[1:])]
    want = {t for t, x in enumerate(reduced) if distance(plain, x) <= ix.budget[0]}
    assert {t for t, *_ in decontam.matches(own, starts, ix)} == want and 20 < len(want) < 180


def test_banded_alignment():
    rng = random.Random(0)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(12))
        b = list("".join(rng.choice("abc") for _ in range(8)) + a + "".join(rng.choice("abc") for _ in range(8)))
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice(["", "d", "ab"])
        b = "".join(b)
        got, _ = decontam.banded(code(a), code(b), -len(a), len(b), 12)
        assert got == distance(a, b)


# the pipeline


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    rng = random.Random(9)
    item = " ".join(words(rng, 40))
    dirty = [(300, " ".join(words(rng, 50)) + " " + item, "en", "src1", 0, "x", "y")]
    spark.createDataFrame([*rows, *dirty], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        after = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or after.columns == docs.columns
        docs = after
        kept.append([r.doc_id for r in docs.collect()])
    assert not {60, 61, 62} & set(kept[0]) and len(kept[0]) == len(rows) + 1 - 3
    assert 8 in kept[1] and not {10, 11} & set(kept[1]) and sorted(x for x in kept[1] if x in (63, 64)) == [63]
    assert set(kept[1]) - set(kept[2]) == {300}
    assert set(kept[3]) <= set(kept[2]) and max(collections.Counter(kept[3]).values()) <= 3
    assert sorted(map(str, kept[4])) == sorted(map(str, kept[3]))
    assert docs.columns[-2:] == ["shard", "slot"]


def test_mix_and_shards_of_the_pipeline(spark, tmp_path):
    """Copies of each document differ from the words taken of it by less than one, sources come near their targets, and shards near their share of all bytes."""
    import corpus_pipeline

    rng = random.Random(19)
    given = [(i, " ".join(words(rng, rng.randint(5, 40))), "en", rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(600)]
    given += [(i, f"text {i}", "en", "d") for i in range(700, 703)] + [(None, "x y z", "en", "a")]
    spark.createDataFrame([(*r, 0, "x", "y") for r in given], DOCS).repartition(3).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    mixed = corpus_pipeline.source_mix(spark, docs, str(tmp_path))
    mixed.write.parquet(str(tmp_path / "mixed"))
    copies = collections.Counter((r.doc_id, r.text, r.source) for r in spark.read.parquet(str(tmp_path / "mixed")).collect())
    taken = {(r.doc_id, r.source): r for r in mixing.mix(docs).collect()}
    got, target = collections.Counter(), {r.source: r.target for r in taken.values()}
    for i, text, _, source in given:
        share, n = taken[i, source].taken / len(text.split()), copies[i, text, source]
        assert abs(n - share) < 1 and n <= 3
        got[source] += n * len(text.split())
    assert sum(copies.values()) == mixed.count() and set(copies) <= {(i, t, s) for i, t, _, s in given}
    assert all(abs(got[s] - t) <= 0.1 * t + 40 for s, t in target.items()), (got, target)
    laid = corpus_pipeline.shards(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in laid:
        sizes[r.shard] += len(r.text.encode()) + 1
        slots[r.shard].append(r.slot)
    assert collections.Counter((r.doc_id, r.text, r.source) for r in laid) == copies and set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(r.text) + 1 for r in laid)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


CLASH = ["a.b", "x`y", "key", "k", "h", "n", "at", "pos", "core", "stretch", "copied", "spans", "node", "bands", "sig", "size", "comp", "chunk", "words", "ids", "lengths", "target", "cell", "taken", "rank", "block", "lang_pred", "score", "media", "n_bytes", "clips", "f0", "f1", "item_id", "host", "path", "rule", "verdict", "keep", "class_id"]


def test_columns_named_alike_change_nothing(spark, docs):
    """Every operator on documents with extra columns named like its own gives what it gives without them, null ids and repeated rows included."""
    alike = docs.withColumns({c: F.lit(f"clash {c}") for c in CLASH})
    items = spark.createDataFrame([(1, " ".join(docs.where("doc_id = 20").first().text.split()[:60]))], "item_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    model = langid.learn(docs)
    score = lambda d: (lambda rows: lm.score(rows, lm.learn(rows)))(lm.flagged(d, good))
    runs = {
        "op2": score, "op3": lambda d: suffixes.repeated_passages(d).drop(common.ROW), "op4": lambda d: langid.label(d, model), "op5": lambda d: urls.judge(d.withColumn("url", F.concat(F.lit("http://x.org/"), "doc_id")), spark.createDataFrame(urls.RULES, "host string, path string, verdict string"), key="doc_id"),
        "op6": mixing.mix, "op7": lambda d: neardup.near_duplicates(d).drop(common.ROW), "op8": lambda d: media.read_avi(media.to_avi(d)), "op9": tokens.attribute, "op10": lambda d: decontam.find(d, items),
    }
    for name, run in runs.items():
        plain, other = (sorted(map(repr, run(d).collect())) for d in (docs, alike))
        assert plain == other and (name == "op10" or len(plain) > 3), name


def test_rows_without_an_id(spark, docs):
    """Null ids are values like others."""
    rows = docs.where("doc_id is null or doc_id in (8, 10)").withColumn("doc_id", F.when(F.col("doc_id") == 8, F.col("doc_id")))
    texts = collections.Counter(r.text for r in rows.collect())
    model = langid.learn(docs)
    assert collections.Counter(r.lang_pred for r in langid.label(rows, model).where("doc_id is null").collect()).total() == 2
    digests = collections.Counter(r.payload_sha256 for r in media.read_avi(media.to_avi(rows)).collect())
    want = collections.Counter()
    for t, n in texts.items():
        raw = t.encode()
        want[hashlib.sha256(raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")).hexdigest()] += n
    assert digests == want
    assert sorted(r.n_tokens for r in tokens.attribute(rows).collect())[-2:] == [r.n_tokens for r in tokens.attribute(docs.where("doc_id in (8, 10)")).collect()]
    groups = collections.Counter(r.class_key for r in neardup.near_duplicates(rows).collect())
    assert sorted(groups.values()) == [1, 2]


def test_pipeline_of_nothing_and_of_columns_named_alike(spark, tmp_path, rows):
    import corpus_pipeline

    names = ["a.b", "x`y", "_id", "_th", "_key", "_n", "_copy", "_copies", "copies", "node", "keep", "k", "h", "size", "taken", "lang_pred", "score"]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given = spark.createDataFrame(rows[:12], DOCS).withColumns({c: F.lit(c) for c in names})
    for kind, docs in (("none", given.where("false")), ("null", given.where("doc_id = 1").withColumn("text", F.lit(None).cast("string"))), ("some", given)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{kind}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{kind}{k}"))
            assert set(columns) <= set(docs.columns) and (k == 4 or docs.columns == columns)
        assert {tuple(r) for r in docs.select(common.quoted(names)).collect()} == ({tuple(names)} if kind == "some" else set())
