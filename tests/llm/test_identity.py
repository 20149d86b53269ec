"""Rows are told apart exactly, reruns of a stage keep the same rows, and small sources cost nothing."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtide.llm import common, mixing, neardup, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(rng, n, ids):
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(120)]
    return [(i, " ".join([*base[:k], f"x{k}", *base[k + 1 :]]), "en", f"s{k % 3}", k) for k, i in zip(range(0, 110, 110 // n), ids)]


def test_row_numbers_are_distinct_and_the_same_in_every_scan(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    rows.repartition(9).write.parquet(str(tmp_path / "a"))
    scan = spark.read.parquet(str(tmp_path / "a"))
    one, two = ({r.doc_id: r[common.ROW] for r in common.with_row(d).select("doc_id", common.ROW).collect()} for d in (scan, scan.where("doc_id % 2 = 0").select("doc_id")))
    assert len(set(one.values())) == 5000 and all(one[i] == n for i, n in two.items())
    top = collections.Counter(v >> 60 for v in one.values())
    assert len(top) == 16 and max(top.values()) < 600  # spread over all of the numbers


def test_spread_is_a_permutation(spark):
    n = 60_000
    got = spark.range(n).select(common.spread(F.col("id")).alias("a"), common.spread(F.shiftleft(F.col("id"), 40)).alias("b")).agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).first()
    assert (got.a, got.b) == (n, n)


def test_alike_tells_nulls_and_columns_apart(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("a", "a")], "x string, `y.z` string")
    got = [r[0] for r in rows.select(common.alike(rows)).collect()]
    assert len(set(got)) == 3 and got[2] == got[3]


def test_reruns_of_the_pipeline_keep_the_same_rows(spark, tmp_path):
    """Near copies with null and equal ids: stages written under other names keep the same ones."""
    import corpus_pipeline

    rng = random.Random(11)
    rows = near_copies(rng, 6, [None] * 6) + near_copies(rng, 6, [3, 1, 2, 1, 1, 9]) + [(100 + i, " ".join(rng.choice("klmnop") + str(rng.randrange(99)) for _ in range(40)), "en", f"s{i % 3}", i) for i in range(30)] + [(None, "two words", "en", "s0", k) for k in range(4)]
    found = {name: set() for name, _ in corpus_pipeline.STAGES[1:]}
    for run in range(2):
        src = str(tmp_path / f"{run}")
        rng.shuffle(rows)
        spark.createDataFrame(rows, DOCS).repartition(run + 1).write.parquet(f"{src}/documents.parquet")
        spark.createDataFrame([(1, "a passage of none of these texts at all in the table")], "item_id long, text string").write.parquet(f"{src}/benchmark.parquet")
        docs = spark.read.parquet(f"{src}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[1:4]:
            docs = common.store(stage(spark, docs, src), f"rerun-{run}")
            found[name].add(tuple(sorted(map(str, docs.collect()))))
        laid = stage_rows(corpus_pipeline.STAGES[4][1](spark, docs, src))
        found[corpus_pipeline.STAGES[4][0]].add(laid)
    assert all(len(v) == 1 for v in found.values()), {k: len(v) for k, v in found.items()}


def stage_rows(df):
    """Rows by shard; slots number rows alike in any order."""
    return tuple(sorted(map(str, df.drop("slot").collect())))


def test_similarity_of_the_joining_link(spark):
    rng = random.Random(5)
    rows = near_copies(rng, 3, [4, 5, 6]) + [(7, "other words are here in this text alone", "en", "s", 0), (8, "a copy of some words", "en", "s", 0), (9, "a copy of some words", "en", "s", 0), (10, None, "en", "s", 0)]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    bag = lambda t: collections.Counter(zip(*[t.split()[k:] for k in range(5)]))
    for i in (4, 5, 6):
        others = [bag(rows[j - 4][1]) for j in (4, 5, 6) if j != i]
        own = bag(rows[i - 4][1])
        assert any(abs(got[i].similarity - (own & o).total() / (own | o).total()) < 1e-9 for o in others)
    assert (got[7].similarity, got[8].similarity, got[9].similarity, got[10].similarity) == (None, 1.0, 1.0, None)


def test_nodes_have_128_bits():
    _, _, _, key = neardup.shingles(pa.array(["a b c", "A b, c", "c b a", "", None], pa.large_string()).fill_null(""))
    assert key.shape == (2, 5) and (key[:, 0] == key[:, 1]).all() and key[0, 0] != key[0, 2] and key[1, 0] != key[1, 2] and not key[:, 3:].any()


def test_texts_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    """With a hash that all texts share, the second one keeps them apart."""
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    other = lambda: " ".join(f"o{rng.randrange(10**6)}" for _ in range(30))
    docs = spark.createDataFrame([(i, f"{other()} {passage} {other()}" if i < 3 else other(), "en", "s", 0) for i in range(6)], DOCS)
    plain = sorted(map(tuple, suffixes.repeated_passages(docs).drop(common.ROW).collect()))
    real = F.xxhash64
    monkeypatch.setattr(suffixes.F, "xxhash64", lambda *c: F.lit(42).cast("long") if len(c) == 1 and isinstance(c[0], str) and c[0] == "text" else real(*c))
    assert sorted(map(tuple, suffixes.repeated_passages(docs).drop(common.ROW).collect())) == plain and len(plain) == 3


# the mix without listed blocks


def listed(n, block, seats, size, k, seed=mixing.SEED):
    """How often each block of a source is taken, block by block."""
    import hashlib

    out = []
    for b in range(n):
        p = b * 16 // n
        first, last = -(-p * n // 16), -(-(p + 1) * n // 16)
        own, gone = last - first, (2 * seats * first + n) // (2 * n)
        quota = (2 * seats * last + n) // (2 * n) - gone
        every, m = divmod(quota, own)
        j = b - first
        extra = 0
        if m:
            s = j * m // own
            s0, s1 = -(-s * own // m), -(-(s + 1) * own // m)
            extra = j == s0 + int(hashlib.md5(f"{seed}:{k}:{p}:{s}".encode()).hexdigest()[:8], 16) % (s1 - s0)
        out.append(every + extra)
    return out


def test_taken_words_against_listed_blocks(spark):
    rng = random.Random(6)
    for n, block, seats in [(1, 5, 2), (3, 1, 9), (40, 7, 61), (257, 3, 100), (1000, 2, 1), (1000, 2, 2999)]:
        size = n * block - rng.randrange(block)
        copies = listed(n, block, seats, size, "k")
        assert sum(copies) == seats and max(copies) <= 3
        ends = np.concatenate([[0], np.cumsum(np.repeat(copies, block)[:size])])
        at = sorted({0, size, *(rng.randrange(size + 1) for _ in range(60))})
        line = spark.createDataFrame([("k", n, block, seats, x) for x in at], "k string, n long, block long, seats long, x long")
        got = {r.x: r.t for r in mixing.taken_words(line, "x", "t", mixing.SEED).collect()}
        assert got == {x: int(ends[x]) for x in at}


@pytest.mark.parametrize("small", [100, 10_000, 1_000_000])
def test_a_small_source_beside_a_very_large_one_makes_no_rows_of_blocks(spark, small):
    """10**12 words beside a few: blocks are not listed, and both sources still meet their targets."""
    s = spark.createDataFrame([("a", 10**12), ("b", small)], "source string, source_size long")
    sources = mixing.seats(mixing.targets(s)).withColumn("k", F.concat(F.lit("="), "source"))
    cuts = sources.withColumn("x", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("source_size") / 3), "source_size")))
    taken = mixing.taken_words(cuts, "x", "t", mixing.SEED).collect()
    assert len(taken) == 6
    for r in taken:
        if r.x == r.source_size:
            assert abs(r.t - r.target) <= max(0.01 * r.target, 2 * r.block)
        elif r.x == 0:
            assert r.t == 0
        else:
            assert abs(r.t - r.target / 3) <= 0.02 * r.target + 16 * r.block


# bounds that a table may reach


def test_items_of_a_word_or_less_than_a_gram(spark):
    """With the least lengths lowered, every item is found as whole words, wherever it stands; by default one or two short words are no passage."""
    import re

    from flowtide.llm import decontam

    items = [(1, "Hello world"), (2, "photosynthesis"), (3, "a"), (4, "b c"), (5, "x-ray 7"), (6, "?!"), (7, None), (8, "a"), (9, "ab cd ef gh")]
    texts = ["hello, WORLD and more", "say hello world", "othello world", "photosynthesis", "photosynthesises", "a", "b a", "ba", "b c", "b  c!", "bb c", "the x ray 7.", "the x ray 77", "", None, "ab cd ef gh", "zab cd ef gh"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    want = {(i, k) for i, t in enumerate(texts) for k, x in items if plain(x).strip() and plain(x) in plain(t)}
    got = decontam.find(docs, table, least=(1, 1)).collect()
    assert {(r.key, r.item_id) for r in got} == want and len(want) > 10
    for r in got:
        assert plain(texts[r.key][r.start : r.end]) == plain(dict(items)[r.item_id])
    assert {(r.key, r.item_id) for r in decontam.find(docs, table).collect()} == {(15, 9)}
    assert {r.doc_id for r in decontam.clean_only(docs, table, (1, 1)).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_a_long_text_of_media_in_runs(monkeypatch):
    """Frames packed and decoded in runs give the same files as all at once, and a long text takes a bounded multiple of its size."""
    import resource

    from flowtide.llm import media

    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (50, 24, 24)).astype(np.uint8)
    px[10:20] = px[9]
    first = np.array([0, 7, 7 + 1, 50])
    whole = media.encode(px, first)
    monkeypatch.setattr(media, "RUN", 9)
    assert media.encode(px, first) == whole
    got, height, width = media.decode(whole)
    assert (height, width) == (24, 24) and (got.reshape(px.shape) == px).all()
    monkeypatch.undo()
    text = "the quick brown fox jumps over the lazy dog " * 450_000
    batch = pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = [r for b in media._encode([batch]) for r in media._decode([b])]
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text)
    assert rows[0].column("payload_bytes")[0].as_py() >= len(text) and grown < 20, grown


def test_labels_beyond_the_bound_are_the_rare_ones(spark, monkeypatch):
    from flowtide.llm import langid

    monkeypatch.setattr(langid, "MOST_LABELS", 3)
    rows = [(i, f"some words of text {i}", lang) for i, lang in enumerate(["a"] * 5 + ["b"] * 4 + ["d"] * 2 + ["c"] * 2 + ["e"])]
    assert langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["a", "b", "c"]


def test_words_of_a_long_text_in_pieces():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Ä1.\u0301ß_-\n") for _ in range(n)) for n in (0, 1, 50, 400, 3000)] + ["x" * 700 + " y"]
    arr = pa.array(texts, pa.large_string())
    whole = common.hashed_words(arr)
    for most in (1, 7, 64, 1000):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(common.hashed_words(arr, most), whole))
        assert ["".join(common.pieces(t, most)) for t in texts] == texts


def test_labels_of_a_long_text_in_pieces(monkeypatch):
    from flowtide.llm import langid

    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b"], rng.normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.ones((len(langid.NAMES), 2), np.bool_))
    texts = pa.array([" ".join(rng.choice(["ab", "cde", "Äx", "7", "-"], 300)), "", "one more text"], pa.large_string())
    whole = [b.to_pylist() for b in langid._part(model, pa.array([1, 2, 3]), texts, 0.1)]
    monkeypatch.setattr(langid, "PASS_CHARS", 40)
    monkeypatch.setattr(langid, "passes", lambda lengths, most=40: common.passes(lengths, most))
    assert [b.to_pylist() for b in langid._part(model, pa.array([1, 2, 3]), texts, 0.1)] == whole and len(whole[0][0]["spans"]) > 3


def test_the_pipeline_leaves_the_results_of_its_stages_only(spark, tmp_path):
    import glob

    import corpus_pipeline
    from flowtide.session import shared_root

    rng = random.Random(1)
    spark.createDataFrame(near_copies(rng, 6, range(6)), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a passage of none of these texts at all in the table")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    root = shared_root(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{root}/*"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{root}/*")) - before]
    assert sorted(left) == sorted(f"pipeline-{name.replace(' ', '-')}" for name, _ in corpus_pipeline.STAGES) and out.count() >= 0
