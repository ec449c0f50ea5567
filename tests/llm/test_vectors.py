"""Operators on embeddings against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from lingoloom.llm import hard_negatives, vector_codes
from lingoloom.llm.queries import op11_hard_negatives, op13_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, q int, id string, a int, p int, score int, part int, block int, rank int, entry int, sums int, n int, of int, error int"


def table(spark, rows):
    """Rows with further columns of clashing names."""
    return spark.createDataFrame([(*r, *[i] * 1, "x", *range(11)) for i, r in enumerate(rows)], SCHEMA)


def random_rows(seed, n, dims, odd=True):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.choice([-0.5, -0.25, 0.0, 0.1, 0.25, rnd.gauss(0, 0.3)]))) for _ in range(dims)], rnd.choice([0, 0, 1, 2, 9])) for i in range(n)]
    if odd:
        rows += [(n, None, 1), (n + 1, [1.0] * (dims - 1) + [None], 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] + [0.0] * (dims - 1), 2), (n + 4, [0.5] * dims, None)]
        rows += [(n + 100 + i, rows[0][1], 3) for i in range(n // 3)]  # a third are copies
    rnd.shuffle(rows)
    return rows


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def mined(rows):
    kept = [(i, whole(v, 256), label) for i, v, label in rows if i is not None and label is not None]
    kept = [(i, q, (label + 1) % 10 if i % 7 == 0 else label) for i, q, label in kept if q is not None]
    out = []
    for a, x, mine in kept:
        if a % 100:
            continue
        scored = sorted((-sum(s * t for s, t in zip(x, q, strict=False)), i, label) for i, q, label in kept if i != a)
        for s, p, _ in [r for r in scored if r[2] == mine][:5]:
            found = [r for r in scored if r[2] != mine and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed,n,dims", [(1, 400, 6), (2, 150, 3)])
def test_hard_negatives(spark, tmp_path, monkeypatch, seed, n, dims):
    rows = random_rows(seed, n, dims)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = mined(rows)
    assert len(want) > 20
    assert sorted(map(tuple, op11_hard_negatives(spark, str(tmp_path)).collect())) == want
    monkeypatch.setattr(hard_negatives, "LEAST", 30)  # more cells, and fewer scores at once
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "SCORES", 64)
    assert sorted(map(tuple, op11_hard_negatives(spark, str(tmp_path)).collect())) == want


def test_hard_negatives_edges(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/0/embeddings.parquet")
    assert op11_hard_negatives(spark, f"{tmp_path}/0").count() == 0
    huge = [(100, [1e30, 1.0], 1), (101, [1e30, 0.5], 1), (102, [1e30, 0.25], 2), (None, [1.0, 1.0], 2), (103, [], 2), (104, [1e30], 3), (200, [0.0, -1.0], 5)]
    table(spark, huge).write.parquet(f"{tmp_path}/1/embeddings.parquet")
    got = op11_hard_negatives(spark, f"{tmp_path}/1").collect()
    top = hard_negatives.whole.__globals__["LIMIT"]
    assert {(r.anchor_id, r.positive_id, r.negative_id, r.negative_score) for r in got} == {(100, 101, 102, top * top + 256 * 64), (100, 101, 104, top * top)}
    # rows of the anchor's own id are neither positives nor negatives, and a repeated anchor answers twice
    twins = [(100, [1.0], 1), (100, [1.0], 1), (100, [1.0], 2), (101, [1.0], 1), (102, [1.0], 2)]
    table(spark, twins).write.parquet(f"{tmp_path}/2/embeddings.parquet")
    assert sorted(map(tuple, op11_hard_negatives(spark, f"{tmp_path}/2").collect())) == [(100, 101, 1, 102, 65536, 65536)] * 2 + [(100, 102, 1, 101, 65536, 65536)]


def coded(rows, parts, entries, rounds, scale=1024):
    kept = [(i, q, label) for i, v, label in rows if (q := whole(v, scale)) is not None]
    width = -(-max(len(q) for _, q, _ in kept) // parts)
    kept = sorted(((i, q + [0] * (width * parts - len(q)), label) for i, q, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda q: [q[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(q)[p] for _, q, _ in kept[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((s - t) ** 2 for s, t in zip(x, y, strict=True)), e) for e, y in enumerate(books[p]))
    for _ in range(rounds):
        held = {}
        for _, q, _ in kept:
            for p, x in enumerate(cut(q)):
                held.setdefault((p, near(p, x)[1]), []).append(x)
        for (p, e), xs in held.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, [near(p, x) for p, x in enumerate(cut(q))], label) for i, q, label in kept]
    total = {}
    for _, found, label in out:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    return sorted(((-1 if i is None else i), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), total[label], digest) for i, f, label in out)


@pytest.mark.parametrize("seed,n,dims", [(3, 500, 8), (4, 40, 8), (5, 350, 6)])
def test_vector_codes(spark, tmp_path, seed, n, dims):
    rows = random_rows(seed, n, dims)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == coded(rows, 4, 256, 4)


def test_vector_codes_edges(spark):
    rows = [(None, [1.0, 2.0], 1), (5, [3.0], None), (5, [3.0], None), (2, [1e30, -1e30, 0.0], 2), (7, None, 1)]
    got = vector_codes.compress(table(spark, rows), parts=2, entries=3, rounds=2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows[3] = (2, [2.0**16, -(2.0**16), 0.0], 2)  # LIMIT / scale
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == coded(rows, 2, 3, 2)
    assert vector_codes.compress(table(spark, [(1, None, 1)])).count() == 0
    # errors that don't fit a long
    far = [(i, [1e30 if i % 2 else -1e30] * 256, 1) for i in range(9)]
    assert {r.label_error for r in vector_codes.compress(table(spark, far), entries=1, rounds=0).collect()} == {None}


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_full_search(seed):
    rnd = np.random.default_rng(seed)
    points = rnd.integers(-4, 5, (200, 3)) * (1 << 25 if seed == 3 else 1)  # many equal entries and equal distances
    x = rnd.integers(-5, 6, (500, 3)) * (1 << 25 if seed == 3 else 1)
    entry, d = vector_codes.nearest(points, vector_codes.tree(points), x)
    full = ((x[:, None] - points[None]) ** 2).sum(2)
    assert (entry == full.argmin(1)).all() and (d == full.min(1)).all()
