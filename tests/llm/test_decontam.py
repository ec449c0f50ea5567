import random

import numpy as np
import pyarrow as pa

from lingoloom.llm import decontam


def make(rnd, n, vocabulary=4000):
    return [rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def test_finds_planted_items_and_leaves_clean_documents(spark):
    rnd = random.Random(4)
    items = [make(rnd, rnd.randint(12, 70)) for _ in range(40)]
    rows, want = [(-1, None), (-2, ""), (-3, "!!! ...")], set()
    for d in range(300):
        words = make(rnd, rnd.randint(5, 400))
        if d % 5 == 0:
            i = rnd.randrange(len(items))
            own = [w.upper() if d % 2 else w + "," for w in items[i]]
            if d % 10 == 0:  # a paraphrase: some words replaced, some added
                own = [rnd.choice(["the", "new"]) if rnd.random() < 0.1 else w for w in own]
                own.insert(len(own) // 2, "indeed")
            at = rnd.randrange(len(words) + 1)
            words[at:at] = own
            want.add((d, i))
        elif d % 7 == 0:  # a third of an item is no leak
            i = rnd.randrange(len(items))
            words += items[i][: len(items[i]) // 3]
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (900, None), (901, "")], "item_id long, text string")
    found = {(r.doc_id, x.item) for r in decontam.leaks(df, bench).collect() for x in r.leaks}
    assert found == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in decontam.leaks(docs, none).collect()] == [[]]
    assert decontam.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_common_subsequence():
    assert decontam._lcs([1, 2, 3, 4], [9, 1, 3, 2, 4]) == 3
    assert decontam.common([1, 2, 3, 4], [4]) == [1, 1]


def test_thousands_of_items_and_long_ones(spark):
    rnd = random.Random(9)
    items = [make(rnd, 600 if i % 500 == 0 else rnd.randint(20, 60)) for i in range(3000)]
    rows, want = [], set()
    for d in range(120):
        words = make(rnd, rnd.randint(50, 300))
        if d % 2 == 0:
            i = 500 * (d % 6) if d % 10 == 0 else rnd.randrange(len(items))
            own = [rnd.choice(["the", "new"]) if d % 4 == 0 and rnd.random() < 0.1 else w for w in items[i]]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = own
            want.add((d, i))
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, x.item) for r in decontam.leaks(df, bench).collect() for x in r.leaks}
    assert found == want


def test_short_items_in_long_foreign_text(spark):
    rnd = random.Random(12)
    items = [make(rnd, rnd.randint(4, 8), 60) for _ in range(200)]
    rows = []
    for d in range(200):
        words = [f"x{rnd.randrange(10**6)}" for _ in range(300)]
        at = rnd.randrange(len(words) + 1)
        words[at:at] = items[d]
        rows.append((d, " ".join(words)))
    # words that are as common elsewhere have little weight beside those that occur once
    rows += [(1000 + d, " ".join(make(rnd, 10, 60)[::-1])) for d in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, x.item) for r in decontam.leaks(df, bench).where("doc_id < 1000").collect() for x in r.leaks}
    assert {(d, d) for d in range(200)} <= found
    clean = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(400)))], "doc_id long, text string")
    assert [r.leaks for r in decontam.leaks(clean, bench).collect()] == [[]]


def test_items_of_thousands_of_words_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 4)
    rnd = random.Random(21)
    items = [make(rnd, n) for n in (60, 300, 600, 1000, 1000, 2000, 2000, 5000, 30, 12)]
    rows = []
    for d in range(30):
        words = make(rnd, rnd.randint(20, 200))
        at = rnd.randrange(len(words) + 1)
        words[at:at] = items[d % 10]
        rows.append((d, " ".join(words)))
    rows += [(100 + d, " ".join(make(rnd, 300))) for d in range(20)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(3, " ".join(items[0]))], "item_id long, text string")
    found = [(r.doc_id, x.item) for r in decontam.leaks(df, bench).collect() for x in r.leaks]
    want = {(d, d % 10) for d in range(30)} | {(d, 3) for d in range(30) if d % 10 == 0}
    assert set(found) == want and len(found) == 2 * len(want)  # repeated rows and ids are reported each


def test_equals_brute_force_over_all_pairs(spark):
    """Every document and item, by plain subsequences of neighbourhoods: what passes the checks anywhere is found, and nothing else."""
    import re

    rnd = random.Random(31)
    items = [make(rnd, rnd.randint(8, 40), 300) for _ in range(25)]
    rows = []
    for d in range(80):
        words = make(rnd, rnd.randint(5, 60), 300)
        if d % 2:
            own = [f"z{rnd.randrange(99)}" if rnd.random() < rnd.choice([0, 0.1, 0.2, 0.5]) else w for w in rnd.choice(items)]
            words[len(words) // 2 : len(words) // 2] = own
        rows.append((d, " ".join(words)))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def holds(text, own):
        words = re.findall(r"[a-z0-9]+", text)
        for f in range(0, max(1, len(words) - decontam.WINDOW + decontam.STEP), decontam.STEP):
            near = words[max(0, f - len(own)) : f + decontam.WINDOW + len(own)]
            cover, n = lcs(own, near) / len(own), max(1, round(decontam.ANSWER * len(own)))
            if cover >= decontam.COVER and (cover >= decontam.NEARLY_ALL or lcs(own[-n:], near) >= decontam.ANSWER_COVER * n):
                return True
        return False

    want = {(d, i) for d, t in rows for i, w in enumerate(items) if holds(t, w)}
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, x.item) for r in decontam.leaks(df, bench).collect() for x in r.leaks}
    assert found <= want and len(found) >= 0.9 * len(want) > 10  # retrieval by cosine is no proof for changed items


def test_search_by_lists_finds_every_pair_that_reaches_the_cosine(monkeypatch):
    """Against dense products, whatever share is left out, in chunks of any size; with repeated words and words of no item."""
    rnd = np.random.default_rng(7)
    idf = rnd.uniform(-0.1, 9, 1 << decontam.CELL_BITS).astype(np.float32)
    word = lambda n, top: " ".join(f"w{int(top * x ** 3)}" for x in rnd.random(n))
    items = [(i, word(int(rnd.integers(1, 200)), 300)) for i in range(60)] + [(60, ""), (61, None)]
    hashes = [h[x:y] for _, _, h, at in decontam.words_of(pa.array([t or "" for _, t in items], pa.large_string())) for x, y in zip(at[:-1], at[1:], strict=True)]
    cells = np.unique((np.concatenate(hashes) >> decontam._SHIFT).astype(np.int64))
    own = decontam.indexed(items, cells, np.eye(len(cells), 4, dtype=np.float32), idf)
    cut = decontam.pieces(hashes)
    assert own.first.tolist() == [sum(i < k for i, _ in cut) for k in range(len(items) + 1)]
    texts = [h for _, _, h, _ in decontam.words_of(pa.array([word(32, 400) for _ in range(200)], pa.large_string()))]
    h = np.concatenate(texts).reshape(-1, 32)
    cell = (h >> decontam._SHIFT).astype(np.int64)
    weight = np.maximum(idf[cell], 0).astype(np.float64)
    total = (weight * weight).sum(1)
    dense = np.zeros((len(cut), 1 << decontam.CELL_BITS))
    for j, (_, w) in enumerate(cut):
        c, n = np.unique((w >> decontam._SHIFT).astype(np.int64), return_counts=True)
        v = n * np.maximum(idf[c], 0)
        dense[j, c] = idf[c] * v / max(np.sqrt((v * v).sum()), 1e-9) * (v > 0)
    want = dense[:, cell].sum(2).T / np.sqrt(total + 1e-9)[:, None]
    close = np.abs(want - decontam.COSINE) < 1e-5  # rounding may put these on either side
    sure = set(zip(*(x.tolist() for x in np.nonzero((want >= decontam.COSINE) & ~close)), strict=True))
    assert close.sum() < 20 and len(sure) > 100
    for share, entries, counted in ((0.0, 1 << 20, 128), (0.8, 1 << 20, 128), (0.8, 64, 3), (0.99, 1000, 1)):
        monkeypatch.setattr(decontam, "LEFT_OUT", share)
        monkeypatch.setattr(decontam, "ENTRIES", entries)
        monkeypatch.setattr(decontam, "COUNTED", counted)
        found = {(p, j): c for x in decontam.reaching(own.row[cell], total, own) for p, j, c in zip(*(y.tolist() for y in x), strict=True)}
        assert sure == {(p, j) for p, j in found if not close[p, j]}
        assert all(abs(c - want[k]) < 1e-4 for k, c in found.items())


def test_blocks_by_pieces_and_repeated_copies(spark, monkeypatch):
    """Blocks of few pieces give the same rows; an item that a text holds often is checked once where it is found whole."""
    rnd = random.Random(21)
    items = [make(rnd, n) for n in (20, 400, 33, 64, 15, 200)]
    rows = [(d, " ".join([*make(rnd, 50), *items[d % 6], *make(rnd, 30), *items[(d + 1) % 6], *items[d % 6]])) for d in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    result = lambda: {(r.doc_id, x.item): (x.cover, round(x.cosine, 4)) for r in decontam.leaks(df, bench).collect() for x in r.leaks}
    whole = result()
    assert set(whole) == {(d, (d + k) % 6) for d in range(12) for k in (0, 1)} and all(c == 1 and x > 0.5 for c, x in whole.values())
    monkeypatch.setattr(decontam, "PIECES", 10)
    assert result() == whole
