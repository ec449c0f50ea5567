"""All queries of the engine by name; their DuckDB SQL is in oracle.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoloom.functions import maps, providers
from lingoloom.functions import text as tx
from lingoloom.functions.diff import lean, pieces
from lingoloom.operators import associations as asc
from lingoloom.operators import drafts as dr
from lingoloom.operators import feedback as fb
from lingoloom.operators import queue as qu
from lingoloom.operators import rules as ru
from lingoloom.operators import states as st
from lingoloom.sources import content_types as ct
from lingoloom.sources.deltas import Store
from lingoloom.sources.folders import shared_folder
from lingoloom.sources.tables import SOURCE_LANGUAGE, Tables
from lingoloom.streaming import events, feed, titles

from . import flows
from .oracle import ORACLES

ARTICLE = "com_content.article"
#: Fixed values of the queries: a planner's batch, a distilling batch, a rule batch's language.
WORK, BATCH, LANGUAGE = 50, 20, "fr-FR"
USER = 1


def _articles(t: Tables) -> DataFrame:
    return t.content_items.where(F.col("content_type") == ARTICLE)


def _languages(t: Tables) -> list[tuple[str, str, int]]:
    return qu.language_list(t.languages, SOURCE_LANGUAGE)


def _texts(t: Tables) -> DataFrame:
    """Source articles' readable text, the same for each target language."""
    return qu.source_items(_articles(t), SOURCE_LANGUAGE).select(F.col("id").alias("item_id"), F.concat_ws(" ", "title", "introtext").alias("text"))


def _codes(t: Tables) -> list[str]:
    return [code for code, _, _ in _languages(t)]


def _rules(t: Tables) -> DataFrame:
    return t.rules.withColumn("source_feedback_ids", F.array(F.col("id"), F.col("id") + 1))


def _item_states(t: Tables) -> DataFrame:
    return _articles(t).select("id", "language", "state")


def _corrections(t: Tables) -> DataFrame:
    return t.snapshots.select("queue_id", "target_language", "field", F.when(F.col("queue_id") % 4 == 0, F.concat("draft", F.lit(" edited"))).otherwise(F.concat("draft", F.lit(" \n"))).alias("correction"))


def _fresh(t: Tables) -> str:
    """A folder for a stream's progress; a query is a run of its own."""
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


def work_queue(t: Tables) -> DataFrame:
    return qu.next_batch(qu.untranslated(t.content_items, t.queue, t.queue_states, _languages(t), SOURCE_LANGUAGE), WORK)


def translate_guards(t: Tables) -> DataFrame:
    return qu.reject_reason(t.content_items, t.queue, LANGUAGE)


def target_languages(t: Tables) -> DataFrame:
    source = qu.source_title(t.languages, SOURCE_LANGUAGE).select(F.col("title").alias("source_title"))
    return qu.target_languages(t.languages, SOURCE_LANGUAGE, ["fr-FR", "es-ES", "it-IT"]).select("lang_code", "title", "ordering").join(F.broadcast(source))


def queue_grid(t: Tables) -> DataFrame:
    return qu.grid(t.content_items, t.queue, t.queue_states, [code for code, _, _ in _languages(t)], SOURCE_LANGUAGE)


def queue_opted_out(t: Tables) -> DataFrame:
    own = qu.opted(qu.with_flag(qu.source_items(t.content_items, SOURCE_LANGUAGE), t.queue), "only")
    return own.select("content_type", "id", "title", "do_not_translate", qu.may_edit(F.col("checked_out"), USER).alias("may_edit"))


def queue_status_filter(t: Tables) -> DataFrame:
    own = qu.source_items(t.content_items, SOURCE_LANGUAGE).select("content_type", "id", "title")
    return qu.with_status(own, t.queue, t.queue_states, [qu.NONE, "review"])


def queue_search(t: Tables) -> DataFrame:
    own = qu.searched(qu.source_items(t.content_items, SOURCE_LANGUAGE), " th an ", ["title"])
    return qu.page(own.select("content_type", "id", "title"), "id", "desc", size=qu.PAGE)


def queue_visibility(t: Tables) -> DataFrame:
    live = asc.visibility(t.associations, _item_states(t), t.queue.select(F.col("content_id").alias("id")))
    own = qu.last_states(t.queue, t.queue_states).where(F.col("content_type") == ARTICLE).select("id", F.col("target_language").alias("language"), "translation_state")
    out = own.join(live, ["id", "language"], "full")
    return out.select("id", "language", "translation_state", "live", *[c.alias(n) for n, c in qu.cell_actions(F.col("translation_state"), F.col("live")).items()])


def queue_search_escaped(t: Tables) -> DataFrame:
    """A search for signs that are wildcards elsewhere finds only themselves: titles here get one of them by id."""
    sign = F.element_at(F.array(*map(F.lit, ["_", "%", "\\", "x"])), (F.col("id") % 4 + 1).cast("int"))
    own = qu.source_items(t.content_items, SOURCE_LANGUAGE).withColumn("title", F.concat("title", F.lit(" a"), sign, F.lit("b")))
    parts = [qu.searched(own, f"a{s}b", ["title"]).select("content_type", "id", F.lit(n).alias("search")) for n, s in enumerate(["_", "%", "\\"])]
    return parts[0].union(parts[1]).union(parts[2])


def item_search_by_id(t: Tables) -> DataFrame:
    """Searches by id: digits after any case of the prefix; without digits it is item 0."""
    own = t.content_items.select("content_type", "id")
    return qu.searched(own, "ID: 12abc", []).withColumn("search", F.lit(12)).union(qu.searched(own, "id:x", []).withColumn("search", F.lit(0)))


def rules_page(t: Tables) -> DataFrame:
    """A page of the published distilled terminology of a language, by confidence from above."""
    own = ru.listed(t.rules, t.languages, t.users, state="1", kind="terminology", language="es-ES", origin="distilled", order="confidence_percent", direction="desc")
    return own.select("id", "rule_name", "confidence_percent", "language_title").limit(qu.PAGE)


def rules_by_state(t: Tables) -> DataFrame:
    """Trashed rules, and all rules, by the filter of states."""
    own = lambda state: ru.listed(t.rules, t.languages, t.users, state=state).select("id", "state", F.lit(state).alias("filter"))
    return own("-2").union(own("*"))


def language_picker(t: Tables) -> DataFrame:
    return qu.picker(t.languages, SOURCE_LANGUAGE)


def submitted_values(t: Tables) -> DataFrame:
    """Items' fields with what was submitted for them in place of what they had."""
    sent = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("translation_title"), F.concat(F.lit("new "), "title"))).otherwise(F.create_map(F.lit("translation_note"), F.lit("noted")))
    own = _articles(t).withColumn("sent", sent)
    return own.select("id", maps.overlaid(F.col("title"), F.col("sent"), "title").alias("title"), maps.overlaid(F.col("note"), F.col("sent"), "note").alias("note"))


def cell_snapshots(t: Tables) -> DataFrame:
    """Cells' drafts as stored (one JSON map a cell), read back; cells without one have an empty list."""
    made = t.snapshots.groupBy("queue_id", "target_language").agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("draft", F.lit("")).alias("draft")))).alias("m"))
    cells = t.queue_states.select("queue_id", "target_language", "translation_state").join(made, ["queue_id", "target_language"], "left")
    stored = cells.withColumn("machine_draft", maps.snapshot(F.coalesce("m", F.create_map().cast("map<string,string>"))))
    back = stored.select("queue_id", "target_language", "translation_state", (F.col("machine_draft") == "[]").alias("empty"), F.explode_outer(maps.of_snapshot(F.col("machine_draft"))).alias("field", "draft"))
    return back


def _pairs(of: Column, between: str) -> Column:
    """A map as text: its pairs in order, one a line."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(of), lambda e: F.concat(e.key, F.lit(between), F.coalesce(e.value.cast("string"), F.lit(""))))), "\n")


def draft_items(t: Tables) -> DataFrame:
    """Drafts of all source items of all types, translated word by word."""
    every = t.content_items.select("content_type", "id", "language", "state")
    items = qu.source_items(t.content_items, SOURCE_LANGUAGE).withColumn("menutype", F.lit("main-en-gb"))
    out = None
    for name, p in ct.TYPES.items():
        own = items.where(F.col("content_type") == name)
        json_fields = {c: k for c, k in p["json_fields"].items()}
        asked = own.select("id", F.lit(LANGUAGE).alias("target_language"), maps.strings(p["fields"], json_fields).alias("strings"), F.lit("").alias("guidance"))
        custom = None
        if name == ARTICLE:
            custom = t.item_fields.select(F.col("item_id").alias("id"), "name", "value", F.col("type").isin("text", "textarea", "editor", "note").alias("translatable"))
            named = custom.where(F.col("translatable") & (tx.trimmed(F.col("value")) != "")).groupBy("id").agg(maps.custom(F.map_from_entries(F.collect_list(F.struct("name", "value")))).alias("more"))
            asked = asked.join(named, "id", "left").withColumn("strings", maps.union(F.col("strings"), F.coalesce("more", F.create_map().cast("map<string,string>")))).drop("more")
        made = providers.translate(asked, [providers.Dictionary({"the": "le", "and": "et", "of": "de"})], SOURCE_LANGUAGE).select("id", "translated")
        tags = t.tag_map.where(F.col("type_alias") == p.get("tags_as", name)).select(F.col("content_item_id").alias("id"), "tag_id")
        d = dr.drafts(items, made, name, LANGUAGE, SOURCE_LANGUAGE, t.associations, every, tags, custom)
        has = lambda c, d=d, kind="string": F.col(c) if c in d.columns else F.lit(None).cast(kind)
        part = d.select(
            F.lit(name).alias("content_type"), "source_id", "id", "language", "title", "alias", has("articletext").alias("articletext"), has("metadesc").alias("metadesc"), has("note").alias("note"),
            has("description").alias("description"), has("images").alias("images"), has("catid", kind="bigint").alias("catid"), F.array_join(has("tags", kind="array<bigint>"), ",").alias("tags"), "state", has("home", kind="int").alias("home"),
            has("parent_id", kind="int").alias("parent_id"), has("menutype").alias("menutype"), _pairs(F.col("associations"), ":").alias("members"), _pairs(has("com_fields", kind="map<string,string>"), "=").alias("custom"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def delete_events(t: Tables) -> DataFrame:
    """What is left after the articles of some ids were deleted."""
    events = _articles(t).where("id % 10 = 0").select(F.lit("delete").alias("event_type"), "content_type", F.col("id").alias("item_id"))
    items, queue, states, _ = feed.deletions(events, _articles(t).select("content_type", "id", "language", "state"), t.queue, t.queue_states, t.associations)
    return items.select(F.lit("item").alias("kind"), "id", F.col("language").alias("detail")).union(queue.select(F.lit("queue"), "id", "content_type")).union(states.select(F.lit("state"), "queue_id", "target_language"))


def optout_events(t: Tables) -> DataFrame:
    """The queue after saves with and without the switch; saves of other languages' items don't count."""
    flag = F.create_map(F.lit("flag"), (F.col("id") % 2).cast("string"))
    events = _articles(t).where("id % 4 <> 3").select(F.lit("save").alias("event_type"), "content_type", F.col("id").alias("item_id"), F.when(F.col("id") % 4 == 2, F.create_map(F.lit("title"), F.lit("x"))).otherwise(flag).alias("payload"))
    return feed.optouts(events, _articles(t), t.queue, SOURCE_LANGUAGE)


def rules_list(t: Tables) -> DataFrame:
    own = ru.listed(t.rules, t.languages, t.users, search="a")
    return own.select("id", "rule_name", "rule_type", "target_language", "language_title", "editor", "state", "ordering")


def association_group(t: Tables) -> DataFrame:
    return asc.translations(t.associations, _item_states(t))


def source_of_translation(t: Tables) -> DataFrame:
    return asc.source_queue(t.associations, t.queue, ARTICLE)


def related_remap(t: Tables) -> DataFrame:
    rows = _articles(t).select("id", F.when(F.col("id") % 6 == 0, 0).otherwise(F.col("id") + 1).cast("bigint").alias("related"))
    return asc.remapped(rows, "related", t.associations, _item_states(t), F.lit(LANGUAGE))


def tag_remap(t: Tables) -> DataFrame:
    """Many to many: each tag by its translation (tags are associated like the articles of their numbers here)."""
    rows = t.tag_map.select("content_item_id", "tag_id")
    out = asc.remapped(rows, "tag_id", t.associations, _item_states(t), F.lit(LANGUAGE))
    return out.groupBy("content_item_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags")).select("content_item_id", F.explode("tags").alias("tag_id"))


def backfill_plan(t: Tables) -> DataFrame:
    return asc.backfill(t.associations, _item_states(t), SOURCE_LANGUAGE)


def source_versions(t: Tables) -> DataFrame:
    return asc.latest_versions(t.history, ct.version_aliases())


def field_assignments(t: Tables) -> DataFrame:
    return asc.field_assignments(t.fields_categories, F.lit(3).cast("bigint"), F.lit(4).cast("bigint"))


def invalidate_translations(t: Tables) -> DataFrame:
    return st.invalidated(t.queue_states, feed.changes(t.history, t.queue))


def upsert_review_state(t: Tables) -> DataFrame:
    changes = t.queue_states.where("queue_id % 5 = 0").select("queue_id", F.when(F.col("queue_id") % 2 == 0, F.col("target_language")).otherwise("it-IT").alias("target_language"), (F.col("source_version_id") + 1).alias("source_version_id"))
    return st.reviewed(t.queue_states, changes)


def ensure_queue(t: Tables) -> DataFrame:
    wanted = t.content_items.where("id % 7 = 0").select("content_type", F.col("id").alias("content_id"))
    return st.ensured(t.queue, wanted)


def seed_states(t: Tables) -> DataFrame:
    plan = asc.backfill(t.associations, _item_states(t), SOURCE_LANGUAGE)
    wanted = plan.select(F.col("source_id").alias("queue_id"), F.col("language").alias("target_language"), F.col("state").alias("translation_state"))
    return st.seeded(t.queue_states, wanted)


def optout_flags(t: Tables) -> DataFrame:
    flags = _articles(t).where("id % 4 <> 3").select("content_type", F.col("id").alias("content_id"), F.when(F.col("id") % 4 == 2, None).otherwise((F.col("id") % 2).cast("int")).alias("flag"))
    out = st.flagged(t.queue, flags)
    return st.cleared(out, out.where("id % 9 = 0").select("id")).select("content_type", "content_id", "do_not_translate")


def delete_cascade(t: Tables) -> DataFrame:
    gone = _articles(t).where("id % 10 = 0").select("id")
    left = asc.removed(t.associations, gone, "com_content.item").select(F.lit("association").alias("kind"), "id", F.col("key").alias("detail"))
    queue, states = st.without_items(t.queue, t.queue_states, gone.select(F.lit(ARTICLE).alias("content_type"), F.col("id").alias("content_id")))
    states = st.without_cells(states, states.where("target_language = 'es-ES' and queue_id % 3 = 0").select("queue_id", "target_language"))
    below = feed.trash_cascade(gone.select(F.lit(ARTICLE).alias("content_type"), "id", F.lit(-2).alias("value")), t.associations, _item_states(t))
    trashed = st.trashed(_item_states(t), below).select(F.lit("item").alias("kind"), "id", F.col("state").cast("string").alias("detail"))
    return left.union(queue.select(F.lit("queue"), "id", "content_type")).union(states.select(F.lit("state"), "queue_id", "target_language")).union(trashed)


def decide_states(t: Tables) -> DataFrame:
    cells = t.queue_states.where("translation_state = 'review' and queue_id % 2 = 1").select("queue_id", "target_language", F.lit("approved").alias("state"))
    return st.decided(t.queue_states, cells)


def regroup_associations(t: Tables) -> DataFrame:
    groups = _articles(t).where("id % 12 < 3").select(F.floor(F.col("id") / 12).alias("group"), F.concat(F.lit("l"), (F.col("id") % 12).cast("string")).alias("language"), "id")
    return asc.regrouped(t.associations, groups, "com_content.item")


def plain_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.plain_text(F.col("html")).alias("text"))


def token_lemmas(t: Tables) -> DataFrame:
    words = _articles(t).where(F.col("language") == SOURCE_LANGUAGE).select(F.explode(tx.tokens(F.col("introtext"))).alias("word")).groupBy("word").agg(F.count("*").alias("items")).withColumn("language", F.lit(SOURCE_LANGUAGE))
    return words.join(t.standard_forms, ["language", "word"], "left").select("word", "items", "standard_form")


def word_batches(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("word"), "doc_id").groupBy("word").agg(F.min("doc_id").alias("at")).withColumn("language", F.lit(SOURCE_LANGUAGE))
    return fb.batches(fb.unknown_words(words, t.standard_forms)).select("word", "batch_id")


def rule_matches(t: Tables) -> DataFrame:
    return ru.matches(_texts(t), ru.published(t.rules), t.standard_forms)


def rule_retrieval(t: Tables) -> DataFrame:
    chosen = ru.selected(_texts(t), ru.published(t.rules), t.standard_forms, languages=_codes(t))
    return chosen.select("item_id", "target_language", "id", "rule_type", "place", F.coalesce("source_term", F.lit("")).alias("source_term"), F.coalesce("target_term", F.lit("")).alias("target_term"))


def rule_guidance(t: Tables) -> DataFrame:
    return ru.guidance(ru.selected(_texts(t), ru.published(t.rules), t.standard_forms, languages=_codes(t)))


def translatable_strings(t: Tables) -> DataFrame:
    p = ct.properties(ARTICLE)
    own = _articles(t).select("id", maps.strings(p["fields"], p["json_fields"]).alias("strings"))
    fields = t.item_fields.where(F.col("type").isin("text", "textarea", "editor", "note") & (tx.trimmed(F.col("value")) != "")).groupBy(F.col("item_id").alias("id")).agg(maps.custom(F.map_from_entries(F.collect_list(F.struct("name", "value")))).alias("more"))
    out = own.join(fields, "id", "left").select("id", maps.union(F.col("strings"), F.coalesce("more", F.create_map().cast("map<string,string>"))).alias("m"))
    return out.select("id", F.explode("m").alias("key", "value"))


def flat_fields(t: Tables) -> DataFrame:
    p = ct.properties(ARTICLE)
    return _articles(t).select("id", F.explode(maps.flattened(p["fields"], p["json_fields"])).alias("key", "value"))


def feedback_pairs(t: Tables) -> DataFrame:
    sources = _articles(t).select(F.col("id").alias("queue_id"), F.explode(F.create_map(F.lit("title"), "title", F.lit("introtext"), "introtext")).alias("field", "source_text"))
    return fb.pairs(t.snapshots, _corrections(t), sources)


def correction_diff(t: Tables) -> DataFrame:
    edited = F.regexp_replace(F.regexp_replace("text", "\\bthe\\b", "that"), "^\\S+ ", "")
    own = t.documents.select("doc_id", F.col("text").alias("machine_draft"), edited.alias("human_correction"))
    return fb.with_diff(own).select("doc_id", "diff_data")


def pending_feedback(t: Tables) -> DataFrame:
    return fb.pending(t.feedback, BATCH).select("id", "target_language", "created_day")


def distil_context(t: Tables) -> DataFrame:
    texts = fb.haystacks(fb.pending(t.feedback))
    rules = t.rules.where(F.col("state").isin(0, 1))
    chosen = ru.selected(texts, rules, t.standard_forms, ru.BATCH_RULES, ru.BATCH_STYLE, drafts_first=True, any_kind=True)
    return chosen.select("target_language", "place", "id", "rule_type", "rule_name", "rule_text", "source_term", "target_term")


def mark_processed(t: Tables) -> DataFrame:
    return st.processed(t.feedback, fb.pending(t.feedback, BATCH).select("id")).select("id", "status")


def rule_validation(t: Tables) -> DataFrame:
    own = t.candidates.withColumns({c: tx.nullable(F.col(c)) for c in ("source_term", "target_term")})
    return ru.checked(own).select("seq", "rule_error", "rule_type", "source_term", "target_term", "search_keywords", "confidence_percent")


def rule_upsert(t: Tables) -> DataFrame:
    batch = t.candidates.withColumn("feedback_ids", F.array("feedback_id", F.col("id")))
    out = ru.upserted(_rules(t), batch, LANGUAGE, t.standard_forms)
    return out.withColumn("feedback_id", F.explode_outer("source_feedback_ids")).drop("source_feedback_ids")


def new_rules(t: Tables) -> DataFrame:
    return ru.new_rule(t.rules.where("id % 3 = 0"), t.rules).select("id", "ordering", "confidence_percent", "rule_text")


def failure_runs(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).alias("ok"))
    return fb.failure_runs(log).groupBy("run_id").agg(F.count("*").alias("steps"), F.max("seq").alias("last_seq"))


def change_feed_invalidate(t: Tables) -> DataFrame:
    key = lambda e: e.select(F.concat(F.lit("com_content.article."), F.col("user_id").cast("string")).alias("item_id"), F.col("event_id").cast("bigint").alias("version_id"))
    return feed.run_invalidation(t.spark, f"{t.sf_dir}/events.parquet", key, t.queue, t.queue_states, _fresh(t))


def dictionary_translate(t: Tables) -> DataFrame:
    p = ct.properties(ARTICLE)
    own = qu.source_items(_articles(t), SOURCE_LANGUAGE)
    asked = own.select("id", F.lit(LANGUAGE).alias("target_language"), maps.strings(p["fields"], p["json_fields"]).alias("strings"), F.lit("").alias("guidance"))
    made = providers.translate(asked, [providers.Dictionary({"the": "le", "and": "et", "of": "de"})], SOURCE_LANGUAGE)
    out = own.join(made, "id")
    new = lambda c: F.coalesce(F.element_at("translated", F.lit(c)), F.col(c))
    alias = tx.draft_alias(new("title"), F.col("alias"), F.lit(LANGUAGE))
    return out.select("id", new("title").alias("title"), alias.alias("alias"), tx.body(new("introtext"), new("fulltext")).alias("body"), maps.packed(F.col("images"), F.col("translated"), "images.").alias("images"), "error")


def item_lookup(t: Tables) -> DataFrame:
    """One item by id; the condition reaches the scan, and an item that isn't there is an error."""
    return qu.source_item(_articles(t), 7).select("id", "title", "language", "state", "alias")


def queue_cells(t: Tables) -> DataFrame:
    """The queue row and the state in one language of each article; null where there is none."""
    own = qu.with_flag(_articles(t).select("content_type", "id"), t.queue)
    cells = t.queue_states.where(F.col("target_language") == LANGUAGE).select("queue_id", "translation_state", "source_version_id")
    return own.join(cells, "queue_id", "left").select("id", "queue_id", "translation_state", "source_version_id")


def item_tags(t: Tables) -> DataFrame:
    own = t.tag_map.where("type_alias = 'com_content.article'").groupBy("content_item_id").agg(F.array_sort(F.collect_list("tag_id")).alias("tags"))
    return own.select(F.col("content_item_id").alias("id"), F.array_join("tags", ",").alias("tags"))


def custom_fields(t: Tables) -> DataFrame:
    """Text fields of items: those with something in them are translated, all are kept in snapshots."""
    own = t.item_fields.where(F.col("type").isin("text", "textarea", "editor", "note"))
    return own.select("item_id", F.concat(F.lit(maps.CUSTOM), "name").alias("key"), "value", (tx.trimmed(F.col("value")) != "").alias("translated"))


def standard_terms(t: Tables) -> DataFrame:
    return ru.with_standard_terms(t.rules.select("id", "source_term", "source_term_standard"), t.standard_forms).select("id", "source_term", "source_term_standard")


def language_menus(t: Tables) -> DataFrame:
    menus = t.nation.select(F.lower("n_name").alias("menutype"), F.col("n_name").alias("title"), F.lit(0).alias("client_id"))
    wanted = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lower("n_name"), F.lit("-en-gb")).alias("menutype"), F.col("n_name").alias("title"), F.lit(LANGUAGE).alias("target_language"))
    return flows.menus_for(menus, wanted, SOURCE_LANGUAGE)


def changed_titles(t: Tables) -> DataFrame:
    """Saves whose title differs from the save before (events as saves)."""
    folder = _fresh(t)
    saves = feed.streamed(t.spark, f"{t.sf_dir}/events.parquet").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("title"))
    titles.write_changes(titles.title_stream(saves), folder).awaitTermination()
    return t.spark.read.schema(f"item_id {saves.schema['item_id'].dataType.simpleString()}, seq bigint, title string, before string").parquet(f"{folder}/changes/*")


def correction_rebuilt(t: Tables) -> DataFrame:
    """Corrections put together again from the words that stay of the draft and their own: the diff has left nothing out."""
    lean(t.spark)
    edited = F.regexp_replace(F.regexp_replace("text", "\\bthe\\b", "that"), "^\\S+ ", "")
    own = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("draft"), F.coalesce(edited, F.lit("")).alias("correction"))
    made = F.struct(tx.diff_tokens(F.col("draft")).alias("old"), tx.diff_tokens(F.col("correction")).alias("new"), pieces("draft", "correction").alias("p"))
    text = lambda s: F.array_join(F.transform(s["p"], lambda x: F.array_join(F.when(x["kept"], F.slice(s["old"], x["first"], x["n"])).otherwise(F.slice(s["new"], x["first"], x["n"])), "")), "")
    # a lambda's variable holds the words: as columns they would be taken apart again for each piece
    return own.select("doc_id", F.sha2(F.element_at(F.transform(F.array(made), text), 1), 256).alias("rebuilt_sha256"))


def packed_images(t: Tables) -> DataFrame:
    """JSON columns with one key translated: numbers, booleans, nulls and nested values survive as what they are."""
    one = F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit(',"flag":'), F.when(F.col("id") % 2 == 0, "true").otherwise("false"), F.lit(',"nested":{"a":[1,2,{"b":"x"}]},"none":null,"image_intro_alt":"old","text":"1"}'))
    made = F.create_map(F.lit("images.image_intro_alt"), F.concat(F.lit('new "'), F.col("id").cast("string"), F.lit('"')), F.lit("title"), F.lit("t"))
    own = _articles(t).select("id", maps.packed(one, made, "images.").alias("j"))
    said = lambda k: F.get_json_object("j", f"$.{k}").alias(k)
    return own.select("id", *map(said, ("n", "flag", "nested", "image_intro_alt", "text")), F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("keys"), F.instr("j", '"text":"1"').cast("boolean").alias("text_is_text"))


def queue_search_accents(t: Tables) -> DataFrame:
    """A search finds titles whatever their case and accents: titles here have accents by id."""
    marked = F.when(F.col("id") % 3 == 0, F.translate("title", "eao", "ÉÄÔ")).when(F.col("id") % 3 == 1, F.translate("title", "eao", "èáö")).otherwise(F.upper("title"))
    own = qu.source_items(t.content_items, SOURCE_LANGUAGE).withColumn("title", marked)
    parts = [qu.searched(own, s, ["title"]).select("content_type", "id", F.lit(s).alias("search")) for s in ("the", "ÉA", "rò ç")]
    return parts[0].union(parts[1]).union(parts[2])


def standard_terms_accents(t: Tables) -> DataFrame:
    """Terms with other case and accents than the stored words have the same standard forms."""
    own = t.rules.select("id", F.translate("source_term", "eaou", "ÉäÔù").alias("source_term"))
    return ru.with_standard_terms(own, t.standard_forms).select("id", "source_term", "source_term_standard")


def translation_run(t: Tables) -> DataFrame:
    """A translating run over the next cells, by a provider that refuses some words: the cells that it got to before two refusals on end, with their
    translated titles and what became of the cells."""
    rules = _rules(t).withColumn("source_term_standard", F.lit(None).cast("string"))  # words need no forms then
    run = flows.translated(t.content_items, t.queue, t.queue_states, rules, t.standard_forms, t.history, qu.language_list(t.languages, SOURCE_LANGUAGE), [providers.Dictionary({"almond": "amande", "red": "rouge"}, refused="lavender")], SOURCE_LANGUAGE, WORK, t.associations)
    own = run.states.select("queue_id", "target_language", "translation_state", "source_version_id")
    cells = own.join(run.queue.select(F.col("id").alias("queue_id"), "content_type", F.col("content_id").alias("id")), "queue_id").drop("queue_id")
    out = run.results.join(cells, ["content_type", "id", "target_language"], "left")
    return out.select("seq", "content_type", "id", "target_language", "ok", F.try_element_at("translated", F.lit("title")).alias("title"), "translation_state", "source_version_id", F.lit(run.outcome).alias("outcome"))


def feed_events(t: Tables) -> DataFrame:
    """The driver's events as the feed's: saves with titles and flags, versions, states and deletions of articles."""
    n = F.col("event_id")
    payload = F.when(F.col("event_type") == "click", F.create_map(F.lit("title"), F.concat(F.lit("title "), (n % 5).cast("string")))).when(F.col("event_type") == "view", F.create_map(F.lit("flag"), (n % 2).cast("string"))).when(F.col("event_type") == "error", F.create_map(F.lit("value"), F.when(n % 4 == 0, "-2").otherwise("1")))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("click", "save"), ("view", "save"), ("error", "state"), ("purchase", "version"), ("signup", "delete")) for x in p]), F.col("event_type"))
    kind = F.when((kind == "delete") & (n % 20 != 0), "version").otherwise(kind)
    return t.events.select(kind.alias("event_type"), F.lit(ARTICLE).alias("content_type"), F.col("user_id").cast("bigint").alias("item_id"), (n % 100).cast("bigint").alias("version_id"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("ts"), n.cast("bigint").alias("seq"))


def event_feed(t: Tables) -> DataFrame:
    """Items, queue, cells and associations of articles after all events, in their order."""
    store = Store(t.spark, _fresh(t), events.kept(_articles(t).select("content_type", "id", "language", "state", "title"), t.queue, t.queue_states, t.associations))
    events.at_once(feed_events(t), store, SOURCE_LANGUAGE)
    said = lambda name, number, *parts: store.read(name).select(F.lit(name).alias("kind"), F.col(number).alias("number"), F.concat_ws("|", *parts).alias("detail"))
    out = said("items", "id", "language", "state", "title").union(said("states", "queue_id", "target_language", "translation_state"))
    return out.union(said("queue", "content_id", "do_not_translate")).union(said("associations", "id", "context", "key"))


QUERIES = [
    correction_rebuilt, packed_images, queue_search_accents, standard_terms_accents, translation_run, event_feed,
    work_queue, item_lookup, queue_cells, item_tags, custom_fields, standard_terms, language_menus, changed_titles, translate_guards, target_languages, queue_grid, queue_opted_out, queue_status_filter, queue_search, queue_visibility, rules_list, association_group, source_of_translation, related_remap, tag_remap,
    backfill_plan, source_versions, field_assignments, invalidate_translations, upsert_review_state, ensure_queue, seed_states, optout_flags, delete_cascade, decide_states, regroup_associations, plain_text, token_lemmas,
    word_batches, rule_matches, rule_retrieval, rule_guidance, translatable_strings, flat_fields, feedback_pairs, correction_diff, pending_feedback, distil_context, mark_processed, rule_validation, rule_upsert, new_rules,
    failure_runs, change_feed_invalidate, dictionary_translate, queue_search_escaped, item_search_by_id, rules_page, rules_by_state, language_picker, submitted_values, cell_snapshots, draft_items, delete_events, optout_events,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
