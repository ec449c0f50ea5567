import pytest
from pyspark.sql import functions as F

from lingoloom.functions import providers as pv


class Silent:
    def translate(self, strings, source, target, rules):
        return None

    distil = normalise = lambda self, *a: None


class Partial:
    def translate(self, strings, source, target, rules):
        return {"extra": "x"} if "fail" in strings.values() else {k: v.upper() for k, v in strings.items()} | {"extra": "x"}


def test_first_answer_counts():
    assert pv.first_answer([Silent(), pv.Dictionary({"a": "b"})], "translate", {"t": "a c"}, "en", "fr", {}) == {"t": "b c"}
    with pytest.raises(RuntimeError):
        pv.first_answer([Silent()], "translate", {}, "en", "fr", {})


def test_translation_keeps_asked_keys_and_fails_alone(spark):
    items = spark.createDataFrame([(1, "fr-FR", {"t": "one"}, ""), (2, "fr-FR", {"t": "fail"}, "")], "id long, target_language string, strings map<string,string>, guidance string")
    out = {r.id: r for r in pv.translate(items, [Silent(), Partial()], "en-GB").collect()}
    assert out[1].translated == {"t": "ONE"} and out[1].error is None and out[2].translated is None and out[2].error


def test_distilling_and_normalising(spark):
    batch = spark.createDataFrame([(2, "fr-FR", "s", "b", "c", "[]"), (1, "fr-FR", "s", "a", "x", "[]"), (3, "de-DE", "s", "d", "e", "")], "id long, target_language string, source_text string, machine_draft string, human_correction string, context string")
    rows = pv.distil(batch, [pv.Dictionary()], "en-GB").orderBy("target_language", "seq").collect()
    assert [(r.target_language, r.source_term, r.feedback_ids) for r in rows] == [("de-DE", "d", [3]), ("fr-FR", "a", [1]), ("fr-FR", "b", [2])]
    words = spark.createDataFrame([(0, "cats"), (0, "dog"), (1, "birds")], "batch_id long, word string")
    assert sorted(r.standard_form for r in pv.normalise(words, [pv.Dictionary()], "en-GB").collect()) == ["bird", "cat"]
    assert pv.normalise(words, [Silent()], "en-GB").select(F.count("*")).first()[0] == 0
