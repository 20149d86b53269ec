"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtide.llm import periods

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, power=4, least=6):
    n, out = len(w), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            smallest = next(p for p in range(1, q + 1) if all(w[k] == w[k + p] for k in range(s, e - p)))
            if e - s >= max(least, power * q) and smallest == q:
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORDS.findall(text or "")
    place = periods.planted(doc_id, len(w))
    if place is not None:
        w = [w[i] for i in place]
    found = brute(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def spliced(rng):
    out = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 20]))]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 120)] + [rng.choice("abcde") for _ in range(rng.randint(0, 4))]
    return out


def test_runs_against_brute_force_in_passes_of_several_texts():
    rng = random.Random(5)
    for _ in range(120):
        texts = [spliced(rng) for _ in range(rng.randint(1, 4))] + [[]]
        codes = np.array([ord(c) for t in texts for c in t], np.int32)
        first = np.cumsum([0, *map(len, texts)])
        got = list(zip(*(x.tolist() for x in periods.runs(codes, first))))
        assert got == [(s + int(lo), length, q) for t, lo in zip(texts, first) for s, length, q in brute(t)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_any_words(w):
    got = periods.runs(np.array(w, np.int32), np.array([0, len(w)]))
    assert list(zip(*(x.tolist() for x in got))) == brute(w)


def test_one_word_filling_a_long_text_is_quick():
    n = 1 << 19
    start, length, period = periods.runs(np.zeros(n, np.int32), np.array([0, n]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [1])
    unit = np.arange(n // 5)
    start, length, period = periods.runs(np.concatenate([unit] * 5), np.array([0, 5 * len(unit)]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [5 * len(unit)], [len(unit)])


SCHEMA = "doc_id long, text string, lang string, runs string, n_words string"


def query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return [tuple(r) for r in periods.op12_periodic_runs(spark, str(tmp_path)).select(*cols).collect()]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(spliced(rng)) for _ in range(150)] + [None, "", " \t\n", "x", "  a a a\x0ba a a a a ", "a\x1cb a\x1cb " * 9, "ä ä ä ä ä ä é", "w " * 3000 + "v u " * 40]
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts)] + [(None, "a b " * 9, None, None, None), (None, None, None, None, None), (5, texts[5], "en", "x", "y")]
    got = query(spark, rows, tmp_path)
    want = [expected(r[0], r[1]) for r in rows]
    assert sum(periods.planted(i, 50) is not None for i in range(150)) > 5
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


@pytest.mark.parametrize("power,least", [(3, 2), (3, 10), (5, 1)])
def test_other_thresholds_and_texts(spark, power, least):
    rng = random.Random(power)
    rows = [(i, " ".join(spliced(rng)), "en", None, None) for i in range(30)]
    out = periods.collapsed(spark.createDataFrame(rows, SCHEMA), power=power, least=least).collect()
    for r in out:
        w = rows[r.doc_id][1].split()
        assert [tuple(x) for x in r.runs] == brute(w, power, least)
        gone = {i for s, length, q in brute(w, power, least) for i in range(s + q, s + length)}
        assert r.text == " ".join(x for i, x in enumerate(w) if i not in gone) and r.n_words == len(w)
