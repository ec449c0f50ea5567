import hashlib
import random

import pytest

from lingoloom.llm import suffix_dedup

N = suffix_dedup.LENGTH


def brute(texts):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - N + 1):
            seen.setdefault(raw[i : i + N], []).append((d, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + N] = b"\1" * N
    out = []
    for raw, g in zip(raws, gone):
        n = sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
        out.append((len(raw), sum(g), n, hashlib.sha256(bytes(c for c, x in zip(raw, g) if not x)).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    make = lambda n, a="abcdefgh é\n": "".join(rnd.choice(a) for _ in range(n))
    shared = [make(n) for n in (150, 199, 200, 201, 260, 500, 900)]
    texts = [None, "", "x" * 199, "x" * 200, "x" * 450, "ab" * 300, "ab" * 99, make(3000, "ab") * 2]
    for _ in range(60):
        t = ""
        for _ in range(rnd.randint(1, 4)):
            t += rnd.choice([make(rnd.randint(0, 300)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 80) :]])
        texts.append(t)
        if rnd.random() < 0.4:
            i = rnd.randrange(len(t) + 1)
            texts.append(t[:i] + rnd.choice(["", "#", "##"]) + t[i:])
    return texts


@pytest.mark.parametrize(("seed", "most", "segment"), [(1, 1024, 4 << 20), (2, 2, 4 << 20), (3, 1024, 1000), (4, 1, 1000)])
def test_equals_brute_force(spark, monkeypatch, seed, most, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, most=most).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "q" * 100 + "r" * 150), (None, "q" * 100 + "r" * 150), (3, None)]
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (250, 250), (250, 250)]
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("widths", [(56, 14, 1), (1,)])
def test_buckets_are_divided_down_to_single_distances(spark, monkeypatch, widths):
    """Many different surroundings of one short line, some of which repeat in part, so that every division still leaves large buckets."""
    monkeypatch.setattr(suffix_dedup, "WIDTHS", widths)
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line = make(190)
    ends = [make(3) for _ in range(6)]
    texts = [make(rnd.randint(0, 200)) + rnd.choice(ends) + line + rnd.choice(ends) + make(rnd.randint(0, 200)) for _ in range(120)]
    texts += texts[:10] + [make(50) + texts[20], texts[21] + "."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, most=1).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_texts_whose_first_halves_are_equal(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = suffix_dedup.halves
    monkeypatch.setattr(suffix_dedup, "halves", lambda text: (F.when(F.length(text) % 2 == 0, F.lit(5)).otherwise(real(text)[0]).cast("long"), real(text)[1]))
    texts = corpus(1)[:40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)
