"""Queries read their whole tables, and use the operators' own limits; by brute force."""

import re

from lingoloom.plans import catalogue
from lingoloom.sources.tables import SOURCE_LANGUAGE, Tables

SF = "/root/testdata/sf0.001"
#: Here there are more style rules than an item gets.
MORE = "/root/testdata/sf0.1"


def test_word_batches_see_every_document(spark):
    t = Tables(spark, SF)
    first = {}
    for r in t.documents.select("doc_id", "text").collect():
        for w in re.split(r"(?:[^\w'-]|_)+", r.text or ""):
            if len(w) >= 3:
                first[w.lower()] = min(r.doc_id, first.get(w.lower(), r.doc_id))
    known = {r.word for r in t.standard_forms.where(f"language = '{SOURCE_LANGUAGE}'").collect()}
    order = sorted((at, w) for w, at in first.items() if w not in known)[:1000]
    found = {(r.word, r.batch_id) for r in catalogue.queries()["word_batches"](spark, SF).collect()}
    assert found == {(w, n // 200) for n, (_, w) in enumerate(order)}


def test_items_get_rules_up_to_the_limits(spark):
    """With more style rules than the limit of style rules, every item has just that many, the best ones."""
    t = Tables(spark, MORE)
    matching = {}
    for r in catalogue.queries()["rule_matches"](spark, MORE).collect():
        matching.setdefault((r.item_id, r.target_language), set()).add(r.rule_id)
    rules = {r.id: r for r in t.rules.where("state = 1").collect()}
    best = sorted(rules.values(), key=lambda r: (-r.confidence_percent, -r.id))
    found = {}
    chosen = catalogue.queries()["rule_retrieval"](spark, MORE).collect()
    for r in sorted(chosen, key=lambda r: r.place):
        found.setdefault((r.item_id, r.target_language), []).append(r.id)
    assert found
    for (item, language), ids in found.items():
        style = [r.id for r in best if r.rule_type == "style" and r.target_language == language][:10]
        want = [r.id for r in best if r.id in style or r.id in matching.get((item, language), ())][:30]
        assert ids == want
    lines = {(r.item_id, r.target_language): r.guidance for r in catalogue.queries()["rule_guidance"](spark, MORE).collect()}
    assert {k: len(re.findall(r"^- ", g, re.M)) for k, g in lines.items()} == {k: len(ids) for k, ids in found.items()}
