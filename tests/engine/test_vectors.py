"""Hand-derived vectors of the text, map and diff functions."""

import json

import pytest
from pyspark.sql import functions as F

from lingoloom.functions import maps
from lingoloom.functions import text as tx
from lingoloom.functions.diff import spans
from lingoloom.operators import associations as asc
from lingoloom.operators import queue as qu
from lingoloom.sources import content_types as ct


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "needle", "want"), [
    ("an Article.", "article", True), ("articles", "article", False), ("well-known", "known", True), ("x", "  ", False), ("a.b\\E c", "b\\e", True), ("Été chaud", "été", True), ("two  words", "two words", False), ("in two words", "two \n words", True), ("C++ code", "c++", True),
])
def test_contains_word(spark, text, needle, want):
    assert one(spark, tx.contains_word(F.col("t"), F.col("n")), t=text, n=needle) is want


@pytest.mark.parametrize(("parts", "want"), [(["<p>one</p><p>two</p>"], "onetwo"), (["a", "b &amp; c"], "a b & c"), (["x &lt;b&gt;"], "x <b>"), (["1 < 2 <i title='>'>it</i>"], "1 < 2 it"), ([" a  b\n"], "a b")])
def test_plain_text(spark, parts, want):
    assert one(spark, tx.plain_text(*[F.lit(p) for p in parts])) == want


def test_words(spark):
    assert one(spark, tx.tokens(F.col("t")), t="It's well-known, X2 it's!") == ["it's", "well-known"]
    assert [one(spark, tx.is_single_word(F.lit(t))) for t in ("well-known", "two words", " ")] == [True, False, False]
    assert one(spark, tx.keywords(F.lit("ab, abc;d  efgh"))) == ["abc", "efgh"]
    assert one(spark, tx.diff_tokens(F.lit("a  b c"))) == ["a  ", "b ", "c"]
    assert [one(spark, tx.word_count(F.lit(t))) for t in ("", " a ", "a b\tc")] == [0, 1, 3]
    assert one(spark, tx.nullable(F.lit(" \x0b"))) is None and one(spark, tx.nullable(F.lit("\tx "))) == "x"
    assert one(spark, tx.normal_case(F.lit("  Two \n Words"))) == "two words"


def test_names(spark):
    assert [one(spark, tx.language_menu(F.lit(m), "en-GB", F.lit("fr-FR"))) for m in ("mainmenu-en-gb", "mainmenu")] == ["mainmenu-fr-fr"] * 2
    assert [one(spark, c) for c in tx.version_key(F.lit("com_content.article.12"))] == ["com_content.article", "12"]
    assert one(spark, tx.short_key(F.lit("com_menus.item"))) == "item"
    assert [one(spark, tx.draft_alias(F.lit(t), F.lit("a-b"), F.lit("fr-FR"))) for t in ("A b!", "New", "?")] == ["a-b-fr-fr", "", ""]
    assert one(spark, tx.body(F.lit("in"), F.lit(" "))) == "in" and one(spark, tx.body(F.lit("in"), F.lit("full"))) == 'in<hr id="system-readmore">full'


@pytest.mark.parametrize(("before", "after", "want"), [
    ("one two three", "one 2 three", ["[term] two → 2"]), ("a b", "a b c", ["[phrase] b → b c"]), ("x", "", ["[removed] x"]), ("", "new text", ["[added] new text"]), ("same", "same", []), ("a b c d", "a x y d", ["[phrase] b c → x y"]),
])
def test_diff(before, after, want):
    assert spans(before, after) == want


def test_maps(spark):
    df = spark.createDataFrame([("t", " ", '{"image_intro_alt":"alt","other":"kept"}')], "title string, note string, images string")
    keys = {"images": ["image_intro_alt", "image_intro_caption"]}
    assert df.select(maps.strings(["title", "note"], keys)).first()[0] == {"title": "t", "images.image_intro_alt": "alt"}
    assert df.select(maps.flattened(["title", "note"], keys)).first()[0] == {"title": "t", "note": " ", "image_intro_alt": "alt", "image_intro_caption": ""}
    import json

    new = F.create_map(F.lit("images.image_intro_alt"), F.lit("neu"), F.lit("title"), F.lit("x"))
    assert json.loads(df.select(maps.packed(F.col("images"), new, "images.")).first()[0]) == {"image_intro_alt": "neu", "other": "kept"}
    assert one(spark, maps.merged_ids(maps.ids_of_json(F.lit("[1,2]")), F.array(F.lit(2), F.lit(3)).cast("array<bigint>"))) == [1, 2, 3]
    assert one(spark, maps.ids_of_json(F.lit("no list"))) == []
    assert one(spark, maps.union(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}
    asked = F.create_map(F.lit("a"), F.lit("x"))
    assert one(spark, maps.kept(F.create_map(F.lit("a"), F.lit("y"), F.lit("z"), F.lit("q")), asked)) == {"a": "y"}


def test_content_types():
    assert ct.dependency_order() == ["com_tags.tag", "com_categories.category", "com_content.article", "com_menus.item"]
    assert ct.dependency_order({"a": {"associated": {"x": "b"}}, "b": {"many": {"y": "a"}}}) == ["b", "a"]
    assert ct.by_version_alias("com_content.category") == "com_categories.category" and ct.by_version_alias("?") is None
    assert ct.by_form("com_menus.item") == "com_menus.item" and ct.related("com_content.article") == ["com_categories.category", "com_tags.tag"]
    with pytest.raises(ValueError, match="unknown"):
        ct.properties("none")


def test_a_map_of_types_in_json(spark, tmp_path):
    given = {"x.note": {"translatableFields": ["title", {"media": ["alt"]}], "table": "#__notes", "versionTypeAlias": "x.n", "optOutForm": "x.form", "context_associations": "x.note", "stateField": "published",
                        "associatedFields": {"boxid": "x.box"}, "limitToClient": 0, "draftForceFields": {"home": 0}},
             "x.box": {"translatableFields": ["title"], "table": "#__boxes", "context_associations": "x.box", "stateField": "state", "associationsByModel": False}}
    path = tmp_path / "types.json"
    path.write_text(json.dumps({"contentTypes": given}, indent=1))
    shipped = dict(ct.TYPES)
    try:
        with pytest.raises(Exception):
            ct.load(spark, str(tmp_path / "missing.json"))
        assert ct.TYPES == shipped
        ct.load(spark, f"file://{path}")
        assert ct.properties("x.note")["json_fields"] == {"media": ["alt"]} and ct.properties("x.note")["client"] == 0 and ct.properties("x.note")["force"] == {"home": 0}
        assert ct.dependency_order() == ["x.box", "x.note"] and ct.versioned() == ["x.note"] and ct.version_aliases() == ["x.n"] and ct.self_associated() == ["x.box"]
        assert ct.by_form("x.form") == "x.note" and ct.properties("x.box")["form"] is None and ct.related("x.note") == ["x.box"]
        tables = {"#__notes": spark.createDataFrame([(1, "a", 1, 7)], "id long, title string, published int, state int"), "#__boxes": spark.createDataFrame([(1, "b", -2)], "id long, title string, state int")}
        rows = ct.items(tables | {"#__other": tables["#__notes"]})
        assert sorted((r.content_type, r.id, r.title, r.state) for r in rows.collect()) == [("x.box", 1, "b", -2), ("x.note", 1, "a", 1)]  # a type's own state column counts
        assert ct.host_rows(rows, "x.note").columns == ["content_type", "published", "id", "title"] and "state" in ct.host_rows(rows, "x.box").columns
        with pytest.raises(ValueError):
            ct.items({})
        history = spark.createDataFrame([("x.n.5", 3), ("x.n.5", 9), ("com_content.article.5", 4), ("x.box.1", 2)], "item_id string, version_id long")
        assert [tuple(r) for r in asc.item_versions(history).collect()] == [("x.note", 5, 9)]
    finally:
        ct.TYPES.clear()
        ct.TYPES.update(shipped)
    for text in ("", "[]", "{", '{"contentTypes": 3}'):
        assert ct.of_json(text) == {}


def test_lookups_of_items(spark):
    items = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "content_type string, id long, title string")
    own = items.where("content_type = 'a'")
    assert [tuple(r) for r in qu.source_item(own, 2).collect()] == [("a", 2, None)] and qu.source_item(own, 2).select("title").count() == 1
    for broken in (qu.source_item(own, 3), qu.source_item(own, 3).select("title"), qu.present(items.where("false").unionByName(spark.createDataFrame([("b", 2, "")], items.schema)), items)):
        with pytest.raises(Exception, match="not found"):
            broken.collect()
    with pytest.raises(Exception, match="not found"):
        qu.source_item(own, 3).count()  # no column of it is asked for
    assert sorted(tuple(r) for r in qu.present(items.select("id", "content_type").union(items.select("id", "content_type")), items).collect() if r.title) == [("a", 1, "x"), ("b", 1, "y")]
    assert qu.item_or_none(None, 1) is None and qu.item_or_none(own, 0) is None and qu.item_or_none(own, 9).count() == 0 and qu.item_or_none(own, 1).count() == 1
