import os

import numpy as np

from lingoloom.llm import common
from lingoloom.llm.components import components


def test_staged_tables_are_read_back_and_dropped(spark):
    df = common.staged(spark.range(5).withColumnRenamed("id", "n"), "few")
    path = common.STAGED[-1]
    assert df.count() == 5 and os.path.exists(path.removeprefix("file:"))
    common.drop_staged(spark)
    assert not common.STAGED and not os.path.exists(path.removeprefix("file:"))


def test_words_do_not_cross_documents_and_ignore_case():
    text = [b"Hello wOrld  a", b"", b"a\tb", b" \n"]
    h, n = common.word_hashes(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
    assert n.tolist() == [3, 0, 2, 0] and h[2] == h[3]
    other, _ = common.word_hashes(np.frombuffer(b"zz hello", np.uint8), np.array([0, 8]))
    assert other[1] == h[0]
    marked, n = common.word_hashes(common.folded(np.frombuffer("ÉTÉ,été!".encode(), np.uint8)), np.array([0, 12]), True)
    assert n.tolist() == [2] and marked[0] == marked[1]


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    out = {r.node: r.component for r in components(links).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[100] == out[101] == 100
    assert components(links.limit(0)).count() == 0
