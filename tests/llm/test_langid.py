import random

from lingoloom.llm import langid

WORDS = {"en": "the house is small and green trees grow over there with some water".split(), "de": "das haus ist klein und grüne bäume wachsen über dort mit etwas wasser".split()}


def test_held_out_accuracy_and_defined_results(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(5, 120))), lang, "x") for i in range(300) for lang in [("en", "de")[i % 2]]]
    odd = [(900, None, "en", "x"), (901, "", "de", "x"), (902, "12 + 3", None, "x"), (903, "the water", None, "x"), (904, "w" * 40_000, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    net = langid.fit(docs.where("doc_id % 3 <> 0"))
    out = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum(out[i].lang_pred == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert langid.fit(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).count() == 0


def test_windows_cover_whole_texts():
    import numpy as np

    data = np.arange(300, dtype=np.uint16).astype(np.uint8)
    x, owner, held = langid.windows(data, np.array([0, 0, 130, 300]))
    assert owner.tolist() == [1, 1, 2, 2] and held.sum() == 300
    assert np.concatenate([r[:n] for r, n in zip(x, held)]).tolist() == data.tolist()


def test_copies_of_a_row_are_drawn_once_and_every_label_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, y, languages: seen.append((len(x), len(set(y.tolist())), languages)))
    rows = [(7, "the same text again", "en")] * 20_000 + [(7, f"other text {i}", "en") for i in range(5)] + [(i, f"text of {i}", f"l{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs)
    assert seen.pop() == (96, 91, sorted({lang for _, _, lang in rows}))
    langid.fit(docs, per_language=4, most=91)
    assert seen.pop()[:2] == (91, 91)


def test_prediction_equals_plain_python(spark):
    """The network's forward pass and the sum over windows, by loops."""
    import math

    import numpy as np

    rnd = random.Random(1)
    labels = ["a", "b", "c"]
    x = np.array([[rnd.randrange(97 + 5 * (i % 3), 110 + 5 * (i % 3)) for _ in range(langid.WINDOW)] for i in range(60)], np.uint8)
    net = langid.train(x, np.arange(60) % 3, labels, epochs=1)
    texts = ["".join(chr(rnd.randrange(97, 123)) for _ in range(rnd.choice([1, 5, 127, 128, 129, 400]))) + rnd.choice(["", "é", " "]) for _ in range(12)] + ["12", "", None]

    def plain(text):
        raw = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        total = [0.0] * 3
        for at in range(0, len(raw), langid.WINDOW):
            own = raw[at : at + langid.WINDOW]
            w = own + bytes(langid.WINDOW - len(own))
            h = []
            for width, table, bias in zip(langid.WIDTHS, net.tables, net.bias):
                for f in range(langid.FILTERS):
                    h.append(max(0.0, max(sum(float(table[j][w[p + j]][f]) for j in range(width)) for p in range(len(w) - width + 1)) + float(bias[f])))
            z = [sum(v * float(net.out[i][k]) for i, v in enumerate(h)) + float(net.out_bias[k]) for k in range(3)]
            norm = math.log(sum(math.exp(v) for v in z))
            total = [t + (v - norm) * len(own) for t, v in zip(total, z)]
        p = [math.exp((t - max(total)) / len(raw)) for t in total]
        return labels[total.index(max(total))], max(p) / sum(p)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(df, net).collect():
        want, score = plain(texts[r.doc_id])
        assert r.lang_pred == want and abs(r.score - score) < 1e-4


def test_query_holds_out_by_crc32_and_learns_only_from_the_rest(spark):
    import zlib

    from lingoloom.llm import queries

    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = queries.op7_language_id(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.held_out for r in out} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in rows} and len(out) == len(rows)
    held = [r for r in out if r.held_out and rows[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.9 * len(held)
