import random

import public_tokenizers
import pytest

import corpus_pipeline
from lingoloom.llm import bpe
from tests.llm.test_jaccard import brute

WORDS = {"en": "the house is small and green trees grow over there with some water".split(), "fr": "la maison est petite et des arbres verts poussent là été déjà où".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    rows, doc = [], lambda lang, n: [rnd.choice(WORDS[lang]) + str(rnd.choice(["", "s", "er"])) for _ in range(n)]
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(doc(lang, 80)), lang))
    items = [" ".join(f"item{j}x{k} {rnd.choice(WORDS['en'])}" for k in range(12)) for j in range(3)]
    rows += [(200 + i, rows[i][1] + " end", rows[i][2]) for i in range(0, 40, 2)]
    rows += [(300, rows[50][1] + " " + items[0], "fr"), (301, items[1].upper() + " " + rows[51][1], "en")]
    rows += [(400, " ".join(doc("en", 60)) + " write to a.b@example.org now", "en"), (401, None, "en"), (402, "123 456", None), (403, "", "fr"), (404, " ".join(doc("en", 60)), None)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_run_equals_brute_force(spark, folder):
    path, rows = folder
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    lettered = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    groups = brute(lettered)
    want = {i for i, _ in lettered if groups[i][1] == i} - {300, 301}
    assert set(out) == want
    texts = dict(lettered)
    own = bpe.codec(public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
    for i, r in out.items():
        text = texts[i].replace("a.b@example.org", "<email>")
        assert (r.text, r.n_chars, r.tokens, r.exact) == (text, len(text), own.library.encode_ordinary(text), True)
    assert out[404].lang == "en"


def test_stages_keep_the_columns_and_stand_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder[0])
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.tokens(spark, docs.limit(0), folder[0]).count() == 0
