"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from flowtide.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, no long, windows string, chunk int"


def expected(rows):
    """rows: (vec_id, embedding, label)."""
    kept = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for i, (a, label, x) in enumerate(kept):
        if a is None or a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b is None, b or 0, b, lb) for j, (b, lb, y) in enumerate(kept) if j != i]
        scored.sort(key=lambda r: r[:3])
        for s, _, _, b, _ in [r for r in scored if r[4] == label][:5]:
            near = [(c, -t) for t, _, _, c, lb in scored if lb != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, b, k + 1, c, -s, t) for k, (c, t) in enumerate(near)]
    return sorted(out, key=str)


def query(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "w", 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted([tuple(r) for r in negatives.op13_hard_negatives(spark, str(tmp_path)).collect()], key=str)


def vectors(rng, n, dim=6, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.randint(0, 3) if i % 3 else 0) for i in range(n)]


def test_against_all_pairs_in_several_chunks(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = vectors(rng, 2600)
    got = query(spark, rows, tmp_path)
    assert len(got) > 500 and got == expected(rows)


def test_ties_copies_nulls_and_lengths(spark, tmp_path):
    rng = random.Random(2)
    grid = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], rng.randint(0, 2)) for i in range(400)]
    rows = grid + [(50, grid[50][1], grid[50][2]), (50, grid[50][1], grid[50][2])] + [(100, [1.0, 1.0, 1.0], 1)] * 3
    rows += [(None, [1.0, 1.0, 1.0], 1), (None, [0.5, 1.0, 1.0], 0), (None, [0.5, 1.0, 1.0], 0), (450, None, 1), (500, [1.0, None, 0.0], 1), (550, [float("nan"), 0.0, 0.0], 1), (600, [float("inf"), 0.0, 0.0], 0), (650, [1.0, 1.0, 1.0], None)]
    rows += [(700, [], 1), (750, [1.0], 1), (751, [0.9], 0), (800, [1.0, 0.0, 0.0, 2.0], 2), (-50, [1.0, 0.25, 1.0], 2), (-7, [0.5, 0.5, 0.5], 9)]
    assert query(spark, rows, tmp_path) == expected(rows)


def test_no_rows_no_anchors_one_label(spark, tmp_path):
    assert query(spark, [], tmp_path / "a") == []
    assert query(spark, [(i, [1.0], i % 2) for i in range(1, 40)], tmp_path / "b") == []
    assert query(spark, [(i * 50, [1.0], 1) for i in (1, 2, 3)], tmp_path / "c") == []


def test_scores_are_exact_and_too_large_ones_an_error():
    rng = np.random.default_rng(0)
    for bits in (10, 27, 29, 45):
        a, b = rng.integers(-(1 << bits), 1 << bits, (4, 5)), rng.integers(-(1 << 15), 1 << 15, (3, 5))
        assert negatives.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[1 << 62]]), np.array([[4]]))


def test_keys_order_as_their_parts():
    rng = random.Random(3)
    some = [(rng.choice([-50, 0, 50]), rng.randint(0, 2), rng.randint(-3, 3), rng.randint(0, 1), rng.random() < 0.2, rng.randint(-4, 4)) for _ in range(300)]
    by_parts = sorted(some, key=lambda r: (r[0], r[1], -r[2], *r[3:]))
    assert [negatives.unpacked(negatives.packed(*r)) for r in by_parts] == [negatives.unpacked(k) for k in sorted(negatives.packed(*r) for r in some)]
