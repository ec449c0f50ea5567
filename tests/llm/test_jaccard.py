import random

import numpy as np
import pytest

from lingoloom.llm import jaccard


def shingle_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    return {k: (len(sets[i]), min(groups[root(i)])) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One TWO"), (5, "one  two three"), (6, "é x y z w"), (7, "É x y z w")]
    for g in range(25):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([3, 5, 8, 30, 60]))]
        for _ in range(rnd.randint(1, 9)):
            own = list(words)
            for _ in range(rnd.randint(0, 1 + len(own) // 25)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(9)}"
            if rnd.random() < 0.5:
                own += common[: rnd.randint(0, 40)]
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids_and_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = [(None, text), (7, text), (7, "other words here that differ entirely from it"), (None, text + " end")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 16, 7), (0, 17, 7), (7, 4, 7), (7, 16, 7)]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_finds_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(5)
    counts = rng.poisson(3, (150, jaccard.GROUPS))
    counts[75:] = counts[:75] + rng.integers(0, 2, (75, jaccard.GROUPS))
    n, comp = counts.sum(1), np.arange(150) % 140
    bound = np.minimum(counts[:, None], counts[None]).sum(2)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if comp[i] != comp[j] and 7 * bound[i, j] >= 3 * (n[i] + n[j])}
    assert {(min(p), max(p)) for p in jaccard.tree_pairs(comp, n, counts).tolist()} == want and want
    token = np.repeat(np.arange(30), 5)
    # counts above what is stored weaken the bound, but keep it one
    small = np.minimum(counts, 3).astype(np.uint8)
    assert want <= {(min(p), max(p)) for p in jaccard.tree_pairs(comp, n, small).tolist()}
    found = {(min(p), max(p)) for part in jaccard.bucket_pairs(token, comp, n, counts) for p in part.tolist()}
    assert found == {(i, j) for i, j in want if i // 5 == j // 5}


def test_thousands_of_copies_of_one_row_make_one_verified_row(spark):
    words = [f"a{i}" for i in range(40)]
    near = [*words[:-1], "other"]
    rows = [(7, " ".join(words))] * 5000 + [(9, " ".join(near))] * 300 + [(3, "something else that stands alone here")]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {(r.doc_id, r.n_shingles, r.component_id): r["count"] for r in out.groupBy(*out.columns).count().collect()}
    assert got == {(7, 36, 7): 5000, (9, 36, 7): 300, (3, 2, 3): 1}
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    docs = spark.createDataFrame(rows, "key long, text string")
    classes = docs.where("key <> 3").distinct().selectExpr("case key when 7 then 1L else 2L end c1", "key", "xxhash64(text) h")
    assert jaccard.verified(pairs, classes, docs, "key", "text").count() == 1


def test_large_buckets_are_cut_by_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 2)
    rnd = random.Random(3)
    shared = [f"s{i}" for i in range(12)]
    rows = []
    for i in range(160):
        own = [f"u{rnd.randrange(40)}" for _ in range(rnd.choice([1, 2, 3, 4, 6, 12, 30]))]
        rows.append((i, " ".join(shared + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_sets_whose_first_halves_are_equal(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = jaccard.described
    monkeypatch.setattr(jaccard, "described", lambda *a: real(*a).withColumn("c1", F.when(F.col("n") % 2 == 0, F.lit(7)).otherwise(F.col("c1")).cast("long")))
    rnd = random.Random(8)
    rows = []
    for _ in range(8):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([30, 60]))]
        for _ in range(4):
            own = list(words)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)
