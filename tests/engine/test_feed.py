from lingoloom.operators import states as st
from lingoloom.plans import catalogue
from lingoloom.sources.tables import Tables
from lingoloom.streaming import feed

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_also_when_repeated_and_cut_up(spark, tmp_path):
    t = Tables(spark, SF)
    history = t.history
    history.union(history.limit(50)).orderBy("version_id", ascending=False).repartition(4).write.parquet(str(tmp_path / "v"))
    want = {(r.id, r.translation_state) for r in st.invalidated(t.queue_states, feed.changes(history, t.queue)).collect()}
    got = feed.run_invalidation(spark, str(tmp_path / "v"), lambda e: e, t.queue, t.queue_states, str(tmp_path))
    assert {(r.id, r.translation_state) for r in got.collect()} == want
    assert {(r.id, r.translation_state) for r in catalogue.queries()["change_feed_invalidate"](spark, SF).collect()} == want


def test_saves_and_defaults(spark):
    saves = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "x")], "item_id long, seq long, title string")
    assert [(r.item_id, r.seq) for r in feed.title_changes(saves).collect()] == [(1, 3)]
    items = spark.createDataFrame([(None, ""), (None, "fr-FR"), (3, "")], "id long, language string")
    assert [r.language for r in feed.default_language(items, "en-GB").collect()] == ["en-GB", "fr-FR", ""]
