import json

import pytest
from pyspark.sql import functions as F

from lingoloom.functions import exchange
from lingoloom.functions.providers import Dictionary
from lingoloom.operators import queue as qu
from lingoloom.operators import rules as ru
from lingoloom.plans import flows
from lingoloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"


class Failing(Dictionary):
    def translate(self, strings, source, target, rules):
        if "8" in strings.get("title", ""):
            raise RuntimeError("no")
        return super().translate(strings, source, target, rules)


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def rules_of(t):
    return t.rules.withColumn("source_feedback_ids", F.array("id").cast("array<bigint>"))


def test_translating_run_marks_cells_for_review(spark, t):
    languages = qu.language_list(t.languages, "en-GB")
    versions = spark.createDataFrame([("com_tags.tag.1", 7), ("com_tags.tag.1", 9), ("com_content.article.1", 30), ("other.1", 40)], "item_id string, version_id long")
    run = flows.translated(t.content_items, t.queue, t.queue_states, rules_of(t), t.standard_forms, versions, languages, [Dictionary({"a": "b"})], "en-GB", size=6)
    rows = run.results.collect()
    assert len(rows) == 6 and run.outcome == "resume" and all(r.error is None and r.translated for r in rows)
    reviewed = run.states.where("translation_state = 'review'").count() - t.queue_states.where("translation_state = 'review'").count()
    assert reviewed == 6 and run.queue.count() == t.queue.count() + len({(r.content_type, r.id) for r in rows})
    assert {r.source_version_id for r in run.states.join(run.queue.where("content_id = 1 and content_type = 'com_tags.tag'"), run.states.queue_id == run.queue.id).select("source_version_id").collect()} == {9}


def test_two_failures_stop_a_run(spark, t):
    items = spark.createDataFrame([("com_tags.tag", i, f"t{8 if i in (2, 3) else 1}", "en-GB", 1, "", 0) for i in range(1, 6)], "content_type string, id long, title string, language string, state int, extension string, client_id int")
    for c in ("introtext", "fulltext", "metadesc", "metakey", "note", "description", "images"):
        items = items.withColumn(c, F.lit(""))
    empty = spark.createDataFrame([], "item_id string, version_id long")
    run = flows.translated(items, t.queue, t.queue_states, rules_of(t), t.standard_forms, empty, [("fr-FR", "French", 2)], [Failing()], "en-GB", size=5)
    assert sorted((r.id, r.ok) for r in run.results.collect()) == [(1, True), (2, False), (3, False)]
    # two failures on end are an error whatever was translated before; a lone one is none
    assert run.outcome == "error" and [flows.outcome(*x) for x in ((0, 5, True), (4, 5, True), (5, 5, False), (4, 5, False), (0, 5, False))] == ["error", "error", "resume", "done", "done"]
    assert run.states.where("translation_state = 'review'").count() == t.queue_states.where("translation_state = 'review'").count() + 1


def test_distilling_run(spark, t):
    forms = flows.normalised(spark.createDataFrame([(1, "New Words here")], "item_id long, text string"), t.standard_forms, [Dictionary()], "en-GB")
    assert forms.where("word = 'words'").first().standard_form == "word"
    run = flows.distilled(t.feedback, rules_of(t), t.standard_forms, [Dictionary()], "en-GB", size=4)
    n = run.batch.count()
    assert n == 4 and run.rules.count() == t.rules.count() + n
    assert run.feedback.where("status = 'processed' and diff_data is not null").count() == n
    assert run.rules.where("source_origin = 'distilled' and state = 0 and size(source_feedback_ids) = 1").count() >= n


def test_terms_menus_and_backfill(spark, t):
    rules = spark.createDataFrame([(1, "Articles"), (2, "two words"), (3, "other")], "id long, source_term string")
    forms = spark.createDataFrame([("articles", "article")], "word string, standard_form string")
    assert {r.id: r.source_term_standard for r in ru.with_standard_terms(rules, forms).collect()} == {1: "article", 2: None, 3: None}
    menus = spark.createDataFrame([("main-fr-fr", "Main", 0)], "menutype string, title string, client_id int")
    wanted = spark.createDataFrame([("main-en-gb", "Main", "fr-FR"), ("main", "Main", "de-DE")], "menutype string, title string, target_language string")
    assert sorted(r.menutype for r in flows.menus_for(menus, wanted, "en-GB").collect()) == ["main-de-de", "main-fr-fr"]
    own = t.content_items.where("content_type = 'com_content.article'").select("id", "language", "state")
    queue, states = flows.backfilled(t.associations, own, t.queue, t.queue_states, "com_content.article", "en-GB")
    again, same = flows.backfilled(t.associations, own, queue, states, "com_content.article", "en-GB")
    assert queue.count() >= t.queue.count() and again.count() == queue.count() and same.count() == states.count()


def test_outside_answers():
    sent = []

    def transport(body):
        sent.append(json.loads(body))
        return 200, json.dumps({"stop_reason": "end", "content": [{"type": "text", "text": json.dumps({"t": "eins", "x": "y"})}]}).encode()

    assert exchange.Remote(transport).translate({"t": "one"}, "en", "de", {"guidance": "Style:\n- short"}) == {"t": "eins"}
    assert "Style:" in sent[0]["system"] and sent[0]["output_format"]["schema"]["required"] == ["t"]
    with pytest.raises(RuntimeError, match="slow down"):
        exchange.Remote(lambda b: (429, b'{"error": {"message": "slow down"}}')).normalise(["a"], "en")
    assert exchange.error_text(b"plain") == "plain"
    for bad in (b"x", b'{"stop_reason": "refusal"}', b'{"content": []}', b'{"content": [{"type": "text", "text": "no json"}]}'):
        with pytest.raises(RuntimeError):
            exchange.decoded(bad)
    forms = {"forms": [{"word": "cats", "standard_form": "cat"}, {"word": "unasked", "standard_form": "x"}, {"word": "dogs", "standard_form": " "}]}
    answer = json.dumps({"content": [{"type": "text", "text": json.dumps(forms)}]}).encode()
    assert exchange.Remote(lambda b: (200, answer)).normalise(["cats", "dogs"], "en") == {"cats": "cat"}


def test_chain_of_distilling_and_retrieving(spark, t):
    """What a distilling run stores can be listed, retrieved by, and refined by the next run."""
    rules = rules_of(t)
    run = flows.distilled(t.feedback, rules, t.standard_forms, [Dictionary()], "en-GB", size=4)
    assert run.rules.columns == rules.columns and run.outcome == "resume"
    new = run.rules.where("source_origin = 'distilled'").join(rules.select("id"), "id", "left_anti").collect()
    top = rules.agg(F.max("id"), F.max("ordering")).first()
    assert len(new) == 4 and {r.id for r in new} == {top[0] + i for i in range(1, 5)} and all(r.ordering > top[1] for r in new)
    texts = spark.createDataFrame([(1, "an article")], "item_id long, text string")
    flows.needs_forms(run.rules)
    flows.retrieved(texts, run.rules.withColumn("state", F.lit(1)), t.standard_forms, [Dictionary()], "en-GB", ["fr-FR"]).count()
    again = flows.distilled(run.feedback, run.rules, t.standard_forms, [Dictionary()], "en-GB", size=4)
    assert again.rules.count() == run.rules.count() + 4 and again.rules.agg(F.countDistinct("id")).first()[0] == again.rules.count()


def test_refined_rules_keep_their_place_and_new_ones_get_a_form(spark, t):
    rows = [(1, "a", "terminology", "fr-FR", "x", "old", "old", "neu", "", 40, 1, 3, 9, "manual", "[1]"), (2, "b", "style", "fr-FR", "s", "", None, "", "", 10, 1, 4, 0, "manual", "[]")]
    rules = spark.createDataFrame(rows, "id long, rule_name string, rule_type string, target_language string, rule_text string, source_term string, source_term_standard string, target_term string, search_keywords string, confidence_percent int, state int, ordering int, checked_out long, source_origin string, source_feedback_ids string")
    cands = [(1, "a2", "terminology", "y", " cats ", "chats", "k", 30, [5, 1], 1), (0, "n", "terminology", "", "dogs", "chiens", "", 20, [6, 6], 2), (0, "", "style", "no name", "", "", "", 20, [7], 3)]
    df = spark.createDataFrame(cands, "id long, rule_name string, rule_type string, rule_text string, source_term string, target_term string, search_keywords string, confidence_percent int, feedback_ids array<long>, seq long")
    forms = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "word string, standard_form string")
    out = {r.id: r for r in ru.upserted(rules, df, "fr-FR", forms).collect()}
    assert (out[1].source_term, out[1].source_term_standard, out[1].confidence_percent, out[1].ordering, out[1].checked_out, out[1].source_feedback_ids, out[1].source_origin) == ("cats", "cat", 40, 3, 9, [1, 5], "manual")
    assert (out[3].source_term_standard, out[3].ordering, out[3].state, out[3].source_feedback_ids, out[3].source_origin) == ("dog", 5, 0, [6], "distilled") and len(out) == 3


def test_chain_of_translating_runs(spark, t):
    """Reviewed cells are not translated again, and their drafts are there to compare corrections with."""
    from lingoloom.functions import maps

    languages = qu.language_list(t.languages, "en-GB")
    states = t.queue_states.withColumn("machine_draft", F.lit(None).cast("string"))
    versions = spark.createDataFrame([("com_content.article.1", 7)], "item_id string, version_id long")
    go = lambda q, s: flows.translated(t.content_items, q, s, rules_of(t), t.standard_forms, versions, languages, [Dictionary({"a": "b"})], "en-GB", size=4, associations=t.associations)
    run = go(t.queue, states)
    first = {(r.content_type, r.id, r.target_language) for r in run.results.collect()}
    new = run.states.join(states.select("id"), "id", "left_anti")
    assert run.states.columns == states.columns and run.states.where("id is null").count() == 0 and len(first) == 4
    shots = run.states.where("machine_draft is not null").select(maps.of_snapshot(F.col("machine_draft")).alias("m")).collect()
    assert len(shots) == 4 and all(r.m["title"] for r in shots) and new.where("machine_draft is null").count() == 0
    grid = qu.last_states(run.queue, run.states)
    for kind, item, language in first:
        assert grid.where(f"content_type = '{kind}' and id = {item} and target_language = '{language}'").first().translation_state == "review"
    assert not first & {(r.content_type, r.id, r.target_language) for r in go(run.queue, run.states).results.collect()}
    assert {k for k, _ in run.drafts} == {kind for kind, _, _ in first}


def test_seeded_and_reviewed_keep_every_column(spark):
    from lingoloom.operators import states as st

    old = spark.createDataFrame([(5, 1, "fr-FR", "pending", 3, "{}"), (9, 2, "de-DE", "approved", 4, None)], "id long, queue_id long, target_language string, translation_state string, source_version_id long, machine_draft string")
    wanted = spark.createDataFrame([(1, "fr-FR", "published"), (3, "de-DE", "review"), (1 << 60, "fr-FR", "published")], "queue_id long, target_language string, translation_state string")
    assert sorted(map(tuple, st.seeded(old, wanted).collect()))[2:] == [(10, 3, "de-DE", "review", 0, None), (11, 1 << 60, "fr-FR", "published", 0, None)]
    changes = spark.createDataFrame([(1, "fr-FR", 7, "new"), (1, "fr-FR", 6, "late"), (4, "fr-FR", 8, "four")], "queue_id long, target_language string, source_version_id long, machine_draft string")
    assert sorted(map(tuple, st.reviewed(old, changes).collect())) == [(5, 1, "fr-FR", "review", 7, "new"), (9, 2, "de-DE", "approved", 4, None), (10, 4, "fr-FR", "review", 8, "four")]


def test_drafts_are_linked_and_deletions_of_self_associated_types_unlink(spark):
    from lingoloom.operators import drafts as dr
    from lingoloom.streaming import feed

    links = spark.createDataFrame([(1, "com_tags.item", "k"), (2, "com_tags.item", "k"), (8, "other", "k")], "id long, context string, key string")
    stored = spark.createDataFrame([("fr-FR", 3, {"en-GB": 1, "de-DE": 2})], "language string, id long, associations map<string,bigint>")
    out = dr.linked(links, stored, "com_tags.tag").collect()
    assert {r.id for r in out if r.context == "com_tags.item"} == {1, 2, 3} and len({r.key for r in out if r.context == "com_tags.item"}) == 1 and len(out) == 4
    items = spark.createDataFrame([("com_tags.tag", i, lang, 1) for i, lang in ((1, "en-GB"), (2, "de-DE"), (3, "fr-FR"))], "content_type string, id long, language string, state int")
    queue = spark.createDataFrame([(7, "com_tags.tag", 1, 0)], "id long, content_type string, content_id long, do_not_translate int")
    states = spark.createDataFrame([(1, 7, "fr-FR"), (2, 7, "de-DE")], "id long, queue_id long, target_language string")
    groups = spark.createDataFrame([(i, "com_tags.item", "k") for i in (1, 2, 3)], "id long, context string, key string")
    gone = lambda i: spark.createDataFrame([("delete", "com_tags.tag", i), ("delete", "unmanaged", 1), ("seen", "com_tags.tag", 2)], "event_type string, content_type string, item_id long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert [ids(x) for x in feed.deletions(gone(3), items, queue, states, groups)] == [[1, 2], [7], [2], [1, 2]]
    assert [ids(x) for x in feed.deletions(gone(1), items, queue, states, groups)] == [[], [], [], [2, 3]]


ITEM = "content_type string, id long, title string, language string, state int, extension string, client_id int"


def items_of(spark, rows):
    items = spark.createDataFrame([(kind, i, title, "en-GB", 1, "com_content" if "categor" in kind else "", 0) for kind, i, title in rows], ITEM)
    return items.withColumns({c: F.lit("") for c in ("introtext", "fulltext", "metadesc", "metakey", "note", "description", "images")})


def test_equal_ids_of_all_types_keep_their_own_texts_and_versions(spark, t):
    """One id in every type: each cell has its own strings, guidance, answer, draft and version."""
    kinds = ["com_tags.tag", "com_categories.category", "com_content.article", "com_menus.item"]
    items = items_of(spark, [(k, i, f"{k[4:6]} {i}") for k in kinds for i in (1, 2)]).withColumn("menutype", F.lit("main-en-gb"))
    history = spark.createDataFrame([("com_tags.tag.1", 77), ("com_content.article.1", 5), ("com_content.category.2", 6), ("com_menus.item.1", 99), ("unknown.1", 100)], "item_id string, version_id long")
    none = t.queue.where("false"), t.queue_states.withColumn("machine_draft", F.lit(None).cast("string")).where("false")
    run = flows.translated(items, *none, rules_of(t), t.standard_forms, history, [("fr-FR", "French", 2), ("de-DE", "German", 3)], [Dictionary()], "en-GB", size=16, associations=t.associations.where("false"))
    rows = run.results.collect()
    assert len(rows) == 16 == len({(r.content_type, r.id, r.target_language) for r in rows}) and run.outcome == "resume"
    assert all(r.translated == {"title": f"{r.content_type[4:6]} {r.id}"} == r.strings for r in rows)
    assert sorted(run.drafts) == sorted((k, c) for k in kinds for c in ("fr-FR", "de-DE")) and all(d.count() == 2 for d in run.drafts.values())
    cells = run.states.join(run.queue.withColumnRenamed("id", "queue_id"), "queue_id").collect()
    assert {(r.content_type, r.content_id): r.source_version_id for r in cells if r.source_version_id} == {("com_tags.tag", 1): 77, ("com_content.article", 1): 5, ("com_categories.category", 2): 6}
    assert len(cells) == 16 and all(json.loads(r.machine_draft)["title"] == f"{r.content_type[4:6]} {r.content_id}" for r in cells)


class Counted(Dictionary):
    """Notes each call in a folder, and fails where the title says so."""

    def translate(self, strings, source, target, rules):
        import pathlib
        import uuid

        pathlib.Path(self.words["folder"], uuid.uuid4().hex).touch()
        if "bad" in strings["title"]:
            raise RuntimeError("no")
        return strings

    def normalise(self, words, language):
        self.translate({"title": ""}, "", "", {})
        return {}


def walk(bad, size, limit=2):
    """The sequential walk: ids that it gets to, and whether it was stopped."""
    seen, streak = [], 0
    for i, b in enumerate(bad[:size], 1):
        seen.append((i, not b))
        streak = streak + 1 if b else 0
        if streak == limit:
            return seen, True
    return seen, False


@pytest.mark.parametrize("seed", [None, 0, 1, 2, 3])
def test_a_run_stops_by_itself(spark, t, tmp_path, seed):
    import random

    rnd = random.Random(seed)
    bad = [True] * 30 if seed is None else [rnd.random() < (0.1, 0.25, 0.3, 0.0)[seed] for _ in range(30)]
    items = items_of(spark, [("com_tags.tag", i, "bad" if b else "good") for i, b in enumerate(bad, 1)])
    none = t.queue.where("false"), t.queue_states.where("false")
    run = flows.translated(items, *none, rules_of(t).where("false"), t.standard_forms, t.history, [("fr-FR", "French", 2)], [Counted({"folder": str(tmp_path)})], "en-GB", size=30)
    seen, stopped = walk(bad, 30)
    assert sorted((r.id, r.ok) for r in run.results.collect()) == seen
    assert run.outcome == ("error" if stopped else "resume" if all(ok for _, ok in seen) else "done")
    calls = len(list(tmp_path.iterdir()))
    assert calls == len(seen) if seed in (None, 3) else len(seen) <= calls <= 30
    assert run.states.count() == sum(ok for _, ok in seen)


def test_empty_answers_end_a_texts_words(spark, t, tmp_path):
    texts = spark.createDataFrame([(1, " ".join(f"worda{i}" for i in range(900))), (2, " ".join(f"wordb{i}" for i in range(150)))], "item_id long, text string")
    flows.normalised(texts, t.standard_forms, [Counted({"folder": str(tmp_path)})], "en-GB").count()
    assert len(list(tmp_path.iterdir())) == 3  # two batches of the first text and the only one of the second


class Stuck(Dictionary):
    def distil(self, corrections, rules, source, target):
        if target == self.words["bad"]:
            raise RuntimeError("no")
        return super().distil(corrections, rules, source, target)


def test_a_failing_language_ends_a_distilling_run(spark, t):
    rows = [(i, lang, f"text {i}", f"draft {i}", f"correction {i}", "pending", day) for i, lang, day in ((1, "de-DE", 1), (2, "fr-FR", 2), (3, "de-DE", 3), (4, "es-ES", 4))]
    feedback = spark.createDataFrame(rows, "id long, target_language string, source_text string, machine_draft string, human_correction string, status string, created_day int")
    run = flows.distilled(feedback, rules_of(t), t.standard_forms, [Stuck({"bad": "fr-FR"})], "en-GB", size=4)
    assert run.outcome == "error" and {r.id for r in run.feedback.where("status = 'processed'").collect()} == {1, 3}
    assert run.rules.count() == t.rules.count() + 2
    run = flows.distilled(feedback, rules_of(t), t.standard_forms, [Dictionary()], "en-GB", size=4)
    assert run.outcome == "resume" and run.feedback.where("status = 'processed'").count() == 4


def test_scheduled_runs_resume_until_a_short_batch(spark, t, tmp_path):
    from lingoloom.sources.deltas import Store

    items = items_of(spark, [("com_tags.tag", i, f"tag {i}") for i in range(1, 9)])
    start = flows.kept(queue=t.queue.where("false"), states=t.queue_states.where("false"), forms=t.standard_forms)
    store = Store(spark, str(tmp_path), start, buckets=2)
    numbers = []

    def keep(number, run):
        numbers.append((number, run.outcome))
        if numbers == [(0, "resume"), (1, "resume")]:
            raise KeyboardInterrupt

    go = lambda: flows.scheduled_translation(store, items, rules_of(t).where("false"), t.history, [("fr-FR", "French", 2)], [Dictionary()], "en-GB", size=3, keep=keep)
    with pytest.raises(KeyboardInterrupt):  # killed before its second run is committed
        go()
    assert store.last("translating") == 0 and store.read("states").count() == 3
    assert go() == ["resume", "done"] and numbers == [(0, "resume"), (1, "resume"), (1, "resume"), (2, "done")]
    assert store.read("states").where("translation_state = 'review'").count() == 8 == store.read("queue").count()
    assert go() == ["done"]


def test_scheduled_distilling(spark, t, tmp_path):
    from lingoloom.sources.deltas import Store

    rows = [(i, "de-DE", f"text {i}", f"draft {i}", f"correction {i}", "pending", i, None) for i in range(1, 4)]
    feedback = spark.createDataFrame(rows, "id long, target_language string, source_text string, machine_draft string, human_correction string, status string, created_day int, diff_data string")
    store = Store(spark, str(tmp_path), flows.kept(feedback=feedback, rules=rules_of(t), forms=t.standard_forms), buckets=2)
    assert flows.scheduled_distilling(store, [Dictionary()], "en-GB", size=2) == ["resume", "done"]
    assert store.read("feedback").where("status = 'processed' and diff_data is not null").count() == 3
    assert store.read("rules").count() == t.rules.count() + 3
