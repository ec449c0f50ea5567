"""Fingerprints by word triples and their links, against plain Python."""

import random
import re

import pytest
from xxhash import xxh64_intdigest

from lingoloom.llm import simhash
from lingoloom.llm.queries import op12_simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, prints, bits=3):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(root(i), []).append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [least[root(i)] for i in range(len(keys))]


def test_documents(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(200)] + ["Ünd", "ÄB", "Q", "naïve", "語"]
    base = [" ".join(rnd.choices(words, k=n)) for n in (5, 60, 400, 2000)]
    texts = [None, "", " \t\n\x0b", "One", "one  ", "one\ttwo", "A b C", "a B c"]
    for b in base:
        for _ in range(25):
            w = b.split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(rnd.choice([" ", "\n", " \r\n"]).join(w))
    texts += [base[1]] * 60
    rows = [(i * 3 % 1000, t, i, i) for i, t in enumerate(texts)] + [(7, base[0], 0, 0), (7, base[2], 0, 0), (None, base[1], 0, 0), (None, "quite alone here today", 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, fp int, key int").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain(t) for _, t, _, _ in rows]
    want = sorted(map(repr, zip([r[0] for r in rows], [f"{p:016x}" for p in prints], components([r[0] for r in rows], prints), strict=True)))
    assert len({p for p in prints}) < len(prints) - 50
    assert sorted(repr(tuple(r)) for r in op12_simhash(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 50)  # texts are read in parts
    assert [simhash.fingerprint((t or "").encode()) % 2**64 for t in texts] == prints[: len(texts)]


@pytest.mark.parametrize("large", [256, 3])
def test_links(spark, large):
    rnd = random.Random(large)
    prints = {0, 1, 7, 15, 2**63, 2**64 - 1}
    for _ in range(6):  # templates: many fingerprints that share a half
        base = rnd.getrandbits(64)
        places = rnd.sample(range(64), 9)
        prints |= {base ^ sum(1 << b for b in rnd.sample(places, rnd.randint(0, 6))) for _ in range(60)}
    prints = sorted(prints)
    signed = {p: p - 2**64 if p >> 63 else p for p in prints}
    want = {tuple(sorted((signed[x], signed[y]))) for i, x in enumerate(prints) for y in prints[:i] if (x ^ y).bit_count() <= 3}
    df = spark.createDataFrame([(signed[p],) for p in prints], "fp long")
    got = simhash.links(df, large=large).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_and_representatives(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.join(empty).count() == 0
    df = spark.createDataFrame([(3, "a b c d", "x"), (2, "A b c d", "y"), (9, "other words are here", "z"), (None, "a b c d", "n")], "doc_id long, text string, fp string")
    assert sorted(map(repr, simhash.representatives(df).collect())) == ["Row(doc_id=2, text='A b c d', fp='y')", "Row(doc_id=9, text='other words are here', fp='z')", "Row(doc_id=None, text='a b c d', fp='n')"]
    with pytest.raises(ValueError):
        simhash.links(df.select("doc_id"), bits=4)
