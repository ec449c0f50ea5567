"""Plain-Python models of the walks, against the set-based forms, on random small inputs."""

import random

from pyspark.sql import functions as F

from lingoloom.operators import associations as asc
from lingoloom.operators import feedback as fb
from lingoloom.operators import queue as qu
from lingoloom.operators import rules as ru
from lingoloom.operators import states as st

RULE = "id long, rule_type string, target_language string, rule_text string, source_term string, source_term_standard string, target_term string, search_keywords string, confidence_percent int, state int, rule_name string"


def rules(rnd, n):
    words = ["alpha", "beta", "gamma", "delta", "two words", "++"]
    return [(i, rnd.choice(["style", "terminology", "preservation", "odd"]), "fr-FR", f"t{i}", rnd.choice([*words, ""]), None, None, ", ".join(rnd.sample(["alpha", "zeta", "of"], rnd.randint(0, 2))), rnd.randint(0, 9), rnd.choice([0, 1]), f"r{i}") for i in range(n)]


def applies(rule, text):
    import re

    found = lambda n: bool(n.strip()) and re.search(rf"(?<![^\W_]){re.escape(n)}(?![^\W_])", text, re.I) is not None
    return found(rule[4]) or any(len(k) >= 3 and found(k) for k in re.split(r"[\s,;]+", rule[7]))


def walk(candidates, text, most, style):
    chosen, styled = [], 0
    for r in candidates:
        if len(chosen) >= most:
            break
        if r[1] == "style":
            if styled >= style:
                continue
            styled += 1
        elif not applies(r, text):
            continue
        chosen.append(r[0])
    return chosen


def test_selection_equals_the_greedy_walk(spark):
    rnd = random.Random(5)
    for _ in range(3):
        own = rules(rnd, 60)
        texts = [(i, "fr-FR", " ".join(rnd.choice(["alpha", "betas", "gamma.", "two words", "x++", "omega"]) for _ in range(rnd.randint(0, 4)))) for i in range(25)]
        df, items = spark.createDataFrame(own, RULE), spark.createDataFrame(texts, "item_id long, target_language string, text string")
        got = {i: [] for i, *_ in texts}
        for r in ru.selected(items, df, most=9, style=3).orderBy("place").collect():
            got[r.item_id].append(r.id)
        ranked = sorted((r for r in own if r[1] != "odd"), key=lambda r: (-r[8], -r[0]))
        assert got == {i: walk(ranked, t, 9, 3) for i, _, t in texts}


def test_caps_of_an_item_with_many_rules(spark):
    own = [(i, "style", "fr-FR", "t", "", None, None, "", 9, 1, "r") for i in range(12)] + [(100 + i, "terminology", "fr-FR", "t", "word", None, "x", "", 5, 1, "r") for i in range(40)]
    items = spark.createDataFrame([(1, "fr-FR", "a word here")], "item_id long, target_language string, text string")
    got = ru.selected(items, spark.createDataFrame(own, RULE)).groupBy("rule_type").count().collect()
    assert {r.rule_type: r["count"] for r in got} == {"style": 10, "terminology": 20}


def test_standard_forms_match_inflected_words(spark):
    own = [(1, "terminology", "fr-FR", "t", "article", "article", "x", "", 5, 1, "r")]
    items = spark.createDataFrame([(1, "fr-FR", "Some Articles"), (2, "fr-FR", "none")], "item_id long, target_language string, text string")
    forms = spark.createDataFrame([("articles", "article")], "word string, standard_form string")
    assert [r.item_id for r in ru.matches(items, spark.createDataFrame(own, RULE), forms).collect()] == [1]


def test_backfill_plan_vector(spark):
    group = [(1, "en-GB", 1), (2, "fr-FR", 1), (3, "de-DE", 0), (4, "es-ES", -2), (5, "*", 1), (6, "fr-FR", 1)]
    items = spark.createDataFrame(group, "id long, language string, state int")
    links = spark.createDataFrame([(i, "c", "k" if i < 6 else "alone") for i, *_ in group], "id long, context string, key string")
    assert sorted(map(tuple, asc.backfill(links, items, "en-GB").collect())) == [(1, "de-DE", "review"), (1, "fr-FR", "published")]


def test_invalidation_vectors(spark):
    states = spark.createDataFrame([(1, 1, "fr-FR", "review", 5), (2, 1, "de-DE", "approved", 7), (3, 1, "es-ES", "pending", 1), (4, 2, "fr-FR", "published", 9)], "id long, queue_id long, target_language string, translation_state string, source_version_id long")
    by = lambda df: {r.id: r.translation_state for r in df.collect()}
    change = lambda *rows: spark.createDataFrame(list(rows), "queue_id long, version_id long")
    once = st.invalidated(states, change((1, 7)))
    assert by(once) == {1: "pending", 2: "approved", 3: "pending", 4: "published"}
    assert by(st.invalidated(once, change((1, 3), (1, 7)))) == by(once)  # repeats and late versions change nothing
    assert by(st.invalidated(states, change((1, None)))) == {1: "pending", 2: "pending", 3: "pending", 4: "published"}


def test_ids_are_numbered_across_partitions(spark):
    queue = spark.createDataFrame([(7, "a", 1, 0)], "id long, content_type string, content_id long, do_not_translate int")
    wanted = spark.createDataFrame([("a", i % 90) for i in range(200)], "content_type string, content_id long").repartition(5)
    out = st.ensured(queue, wanted)
    assert sorted(r.id for r in out.collect()) == [7, *range(8, 97)] and out.select("content_id").distinct().count() == 90


def test_association_groups_shrink_and_are_rewritten(spark):
    links = spark.createDataFrame([(1, "c", "k"), (2, "c", "k"), (3, "c", "k"), (4, "c", "p"), (5, "c", "p"), (1, "other", "k")], "id long, context string, key string")
    gone = spark.createDataFrame([(1,), (4,)], "id long")
    assert sorted((r.id, r.context) for r in asc.removed(links, gone, "c").collect()) == [(1, "other"), (2, "c"), (3, "c")]
    groups = spark.createDataFrame([(1, "en", 2), (1, "fr", 9), (2, "en", 5)], "group long, language string, id long")
    out = {(r.id, r.context): r.key for r in asc.regrouped(links, groups, "c").collect()}
    assert out[2, "c"] == out[9, "c"] and len(out[2, "c"]) == 32 and out[5, "c"] == "p"


def test_search_forms():
    assert qu.like_pattern(" 50%_x y ") == "%50\\%\\_x%y%" and qu.like_pattern("a_b", escape=False) == "%a_b%"
    assert [qu.search_id(s) for s in ("id:12abc", "ID:x", "title")] == [12, 0, None]


def test_failure_runs_stop_after_two(spark):
    rnd = random.Random(1)
    logs = {run: [rnd.random() < 0.6 for _ in range(12)] for run in range(30)}
    df = spark.createDataFrame([(run, i, ok) for run, log in logs.items() for i, ok in enumerate(log)], "run_id long, seq long, ok boolean")
    got = {r.run_id: r["count"] for r in fb.failure_runs(df).groupBy("run_id").count().collect()}
    for run, log in logs.items():
        steps = fails = 0
        for ok in log:
            steps, fails = steps + 1, 0 if ok else fails + 1
            if fails == 2:
                break
        assert got[run] == steps


def test_work_queue_equals_the_walk(spark):
    rnd = random.Random(9)
    kinds = ["com_content.article", "com_tags.tag", "com_menus.item", "com_categories.category"]
    items = [(rnd.choice(kinds), i, rnd.choice(["en-GB", "fr-FR"]), rnd.choice([1, 0, -2]), rnd.choice(["com_content", "x"]), rnd.choice([0, 1])) for i in range(60)]
    queue = [(i, t, i, rnd.choice([0, 0, 1])) for t, i, *_ in items if rnd.random() < 0.6]
    states = [(q * 10 + k, q, lang, rnd.choice(["pending", "review"])) for q, *_ in queue for k, lang in enumerate(["fr-FR", "de-DE"]) if rnd.random() < 0.5]
    want = []
    for rank, kind in enumerate(["com_tags.tag", "com_categories.category", "com_content.article", "com_menus.item"]):
        for lang in ["fr-FR", "de-DE"]:
            for t, i, own, state, ext, client in sorted(items, key=lambda x: x[1]):
                if t != kind or own != "en-GB" or state == -2 or (kind == "com_categories.category" and ext != "com_content") or (kind == "com_menus.item" and client):
                    continue
                flag = next((d for q, _, c, d in queue if c == i), 0)
                st_ = next((s for _, q, la, s in states if q == i and la == lang), None)
                if not flag and st_ in (None, "pending"):
                    want.append((kind, i, lang))
    df = qu.untranslated(
        spark.createDataFrame(items, "content_type string, id long, language string, state int, extension string, client_id int"), spark.createDataFrame(queue, "id long, content_type string, content_id long, do_not_translate int"),
        spark.createDataFrame(states, "id long, queue_id long, target_language string, translation_state string"), [("fr-FR", "French", 2), ("de-DE", "German", 3)], "en-GB",
    )
    assert [tuple(r)[:3] for r in qu.next_batch(df, 15).collect()] == want[:15]
    assert df.count() == len(want)


def test_marks_of_processed_feedback(spark):
    feedback = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, status string")
    out = {r.id: (r.status, r.diff_data) for r in st.processed(feedback, spark.createDataFrame([(1, "d")], "id long, diff_data string")).collect()}
    assert out == {1: ("processed", "d"), 2: ("pending", None)}
    assert {"modified", "created_by"} <= set(st.stamped(feedback, 5).columns) and st.stamped(feedback).select(F.max("modified_by")).first()[0] == 0


def test_audit_of_rules(spark):
    """Refined rules are stamped as modified, new ones as created too; the others stay."""
    schema = RULE + ", source_feedback_ids array<long>, source_origin string, modified timestamp, modified_by long, created timestamp, created_by long"
    row = lambda i: (i, "style", "fr-FR", f"t{i}", None, None, None, "", 50, 1, f"r{i}", [1], "manual", None, 3, None, 4)
    stored = spark.createDataFrame([row(1), row(2)], schema)
    found = spark.createDataFrame([(2, "n", "style", "new", "", "", "", 60, [5], 1), (0, "m", "style", "made", "", "", "", 60, [6], 2)], "id long, rule_name string, rule_type string, rule_text string, source_term string, target_term string, search_keywords string, confidence_percent int, feedback_ids array<long>, seq int")
    out = {r.id: r for r in ru.upserted(stored, found, "fr-FR", user=8).collect()}
    assert {i: (r.modified is not None, r.modified_by, r.created is not None, r.created_by) for i, r in out.items()} == {1: (False, 3, False, 4), 2: (True, 8, False, 4), 3: (True, 8, True, 8)}
    assert ru.upserted(stored, found, "fr-FR").where("id = 3").first().created_by == 0  # a scheduled run has no user
    made = ru.new_rule(spark.createDataFrame([(9, 0, None, 2)], "id long, confidence_percent int, rule_text string, created_by long"), stored.withColumn("ordering", F.lit(4)), 8).first()
    assert (made.ordering, made.confidence_percent, made.rule_text, made.created_by, made.modified_by, made.created is not None) == (5, 100, "", 2, 8, True)


def test_word_batches_are_cut_before_they_meet(spark):
    rows = [(lang, f"{lang}{i:05}", i) for lang in ("a", "b") for i in range(1500)]
    out = fb.batches(spark.createDataFrame(rows, "language string, word string, at long").repartition(4))
    assert sorted((r.language, r.batch_id, r.word) for r in out.collect()) == sorted((lang, i // 200, word) for lang, word, i in rows if i < 1000)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
