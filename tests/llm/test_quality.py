import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lingoloom.llm import quality


def brute(rows, trusted):
    """A plain-Python version: (perplexity, threshold, keep) by id. rows: id, text, language."""
    use = {i: 2 if zlib.crc32(str(i).encode()) % quality.FOLD == 0 else 1 for i in trusted}
    counts = {k: Counter() for k in range(1, quality.ORDER + 1)}
    padded = lambda t: bytes([255] * (quality.ORDER - 1)) + (t or "").encode()
    for i, t, _ in rows:
        if use.get(i) == 1:
            raw = padded(t)
            counts[quality.ORDER].update(raw[j - 4 : j + 1] for j in range(4, len(raw)))
    for k in range(quality.ORDER - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    less, whole, weight = {}, defaultdict(int), defaultdict(float)
    for k, table in counts.items():
        n = Counter(table.values())
        less[k] = quality.discounts(n[1], n[2], n[3], n[4])
        for g, c in table.items():
            whole[k, g[:-1]] += c
            weight[k, g[:-1]] += less[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        if not whole[k, g[:-1]]:
            return p(g[1:])
        c = counts[k][g]
        return ((c - less[k][min(c, 3) - 1] if c else 0) + weight[k, g[:-1]] * p(g[1:])) / whole[k, g[:-1]]

    score = {}
    for i, t, _ in rows:
        raw = padded(t)
        score[i] = math.exp(-sum(math.log(p(raw[j - 4 : j + 1])) for j in range(4, len(raw))) / (len(raw) - 4)) if t else None

    def place(values):
        values = sorted(values)
        return values[max(0, math.ceil(quality.QUANTILE * len(values)) - 1)] if values else None

    held = [(lang, score[i]) for i, _, lang in rows if use.get(i) == 2 and score[i] is not None]
    every = place([s for _, s in held]) or place([score[i] for i, _, _ in rows if i in use and score[i] is not None])
    out = {}
    for i, _, lang in rows:
        own = [s for x, s in held if x == lang]
        limit = place(own) if len(own) >= quality.ENOUGH else every
        out[i] = score[i], limit, score[i] is not None and (limit is None or score[i] <= limit * (1 + 1e-9))
    return out


def sample(seed):
    rnd = random.Random(seed)
    words = {"en": "the house is small and green trees grow".split(), "ru": "дом стоит на горе и река течёт вниз".split()}
    clean = lambda lang: " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 40))) + "."
    rows = [(i, clean("en" if i % 2 else "ru"), "en" if i % 2 else "ru") for i in range(300)]
    junk = lambda letters: "".join(rnd.choice(letters) for _ in range(150))
    rows += [(1000 + i, junk("#$%&|{}xq"), "en") for i in range(10)] + [(1100 + i, junk("абвгдежзийкл мнопрстуфхц"), "ru") for i in range(10)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, "x", None), (2003, "the house " * 900, "en"), (2004, "漢字", None)]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_equals_brute_force_row_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    monkeypatch.setattr(quality, "PIECE", block)  # texts of more bytes are cut
    monkeypatch.setattr(quality, "LANE", 2)
    monkeypatch.setattr(quality, "ENOUGH", 20)
    rows = sample(block)
    trusted = list(range(240))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    want = brute(rows, trusted)
    assert set(out) == set(want)
    for i, (score, limit, keep) in want.items():
        assert (out[i].perplexity is None) == (score is None) and math.isclose(out[i].threshold, limit, rel_tol=1e-4)
        assert score is None or math.isclose(out[i].perplexity, score, rel_tol=1e-4)
        assert out[i].keep == keep or math.isclose(score, limit, rel_tol=1e-4)
    # junk of the language's own letters goes, in any script
    assert not any(out[i].keep for i in (*range(1000, 1010), *range(1100, 1110))) and sum(out[i].keep for i in range(300)) >= 280


def test_repeated_rows_ties_and_nothing_trusted(spark):
    rows = [(7, "the same text", "en")] * 40 + [(8, "another text", "en"), (None, "the same text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.classify(docs, spark.createDataFrame([(7,), (7,), (None,)], "doc_id long")).collect()
    assert len(out) == 42 and len({r.perplexity for r in out if r.doc_id == 7}) == 1
    assert all(r.keep for r in out if r.doc_id == 7)  # at the threshold
    bare = quality.classify(docs, docs.limit(0).select("doc_id")).collect()
    assert all(r.keep and r.threshold is None and math.isclose(r.perplexity, 256, rel_tol=1e-6) for r in bare)
    assert quality.classify(docs.limit(0), docs.limit(0).select("doc_id")).count() == 0


def test_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    rows = sample(5)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.perplexity for r in quality.classify(docs, docs.where("doc_id < 40").select("doc_id")).collect()}
    want = brute(rows, range(40))
    assert all(math.isclose(out[i], want[i][0], rel_tol=1e-4) for i in out)


def test_codes_do_not_cross_documents():
    one = quality.codes(np.frombuffer(b"abcab", np.uint8), np.array([0, 3, 3, 5]))
    two = quality.codes(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    assert one[3:].tolist() == two.tolist() and quality.codes(np.zeros(0, np.uint8), np.array([0, 0])).size == 0
