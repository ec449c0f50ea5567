"""The runs that tie operators and providers together: retrieving, distilling, translating."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lingoloom.functions import maps, providers
from lingoloom.functions import text as tx
from lingoloom.operators import associations as asc
from lingoloom.operators import drafts as dr
from lingoloom.operators import feedback as fb
from lingoloom.operators import queue as qu
from lingoloom.operators import rules as ru
from lingoloom.operators import states as st
from lingoloom.sources import content_types as ct
from lingoloom.sources.deltas import Store
from lingoloom.sources.folders import shared_folder

#: Failures on end that stop a translating run, and the most items that are asked for at once.
FAILURES, WAVE = 2, 64


def needs_forms(rules: DataFrame) -> bool:
    """Whether any rule has a standard form; else words need not be normalised."""
    return not rules.where(F.coalesce("source_term_standard", F.lit("")) != "").isEmpty()


def normalised(texts: DataFrame, forms: DataFrame, own: Sequence, language: str) -> DataFrame:
    """The forms, with those added that providers give for the texts' (item_id, text) unknown words: in batches of 200, five at most for a
    text, and none after two empty answers on end. A word of some texts is asked for with the first. Answers are written before they are
    used, so that nobody is asked twice."""
    words = texts.select("item_id", F.posexplode(tx.tokens(F.col("text"))).alias("at", "word"))
    wanted = words.groupBy("word").agg(F.min(F.struct("item_id", "at")).alias("one")).select("word", "one.*", F.lit(language).alias("language"))
    asked = fb.batches(fb.unknown_words(wanted, forms), by="item_id")
    found = written(providers.normalise(asked, own, language), "forms").join(forms, ["language", "word"], "left_anti")
    return forms.select("language", "word", "standard_form").unionByName(found)


def retrieved(texts: DataFrame, rules: DataFrame, forms: DataFrame, own: Sequence, language: str, languages: list[str] | None = None) -> DataFrame:
    """The published rules for each text, ranked and capped; words are normalised only if a rule could match by them."""
    published = ru.published(rules)
    known = normalised(texts, forms, own, language) if needs_forms(published) else None
    return ru.selected(texts, published, known, languages=languages)


@dataclass
class Distilled:
    rules: DataFrame
    feedback: DataFrame
    #: the feedback that was gone through, with its diffs
    batch: DataFrame
    #: the standard forms with those that were learned
    forms: DataFrame
    outcome: str


def distilled(feedback: DataFrame, rules: DataFrame, forms: DataFrame, own: Sequence, source: str, size: int = 10) -> Distilled:
    """One distilling run: the oldest pending feedback is diffed and, language by language, turned into rule candidates.

    Valid candidates are stored; feedback is marked as processed even if none was. Languages are asked in the order in which they come in the
    batch; one that fails ends the run, and what the languages before it gave stays. The batch's size bounds all that is collected.
    """
    seen = Observation()
    batch = written(fb.with_diff(fb.pending(feedback, size)).observe(seen, F.count("*").alias("n")), "batch")
    order = [] if not seen.get["n"] else batch.groupBy("target_language").agg(F.min(F.struct("created_day", "id")).alias("first")).orderBy("first").collect()
    known = normalised(fb.haystacks(batch), forms, own, source) if order and needs_forms(rules) else forms
    gone, failed = [], False
    for (language, _) in order:
        part = batch.where(F.col("target_language") == language)
        chosen = ru.selected(fb.haystacks(part), rules.where(F.col("state").isin(0, 1)), known, ru.BATCH_RULES, ru.BATCH_STYLE, drafts_first=True, any_kind=True)
        one = F.struct("place", "id", "rule_type", "rule_name", "rule_text", "source_term", "target_term")
        context = chosen.groupBy("target_language").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("context"))
        # a provider is asked once: its answers are written, so that a lost executor asks nobody again
        candidates = written(providers.distil(part.join(context, "target_language", "left"), own, source), "candidates")
        if failed := not candidates.where("error is not null").isEmpty():
            break
        terms = candidates.select(F.lit(0).cast("bigint").alias("item_id"), F.col("source_term").alias("text")).where("text is not null")
        known = normalised(terms, known, own, source)
        rules = ru.upserted(rules, candidates.drop("target_language", "error"), language, known)
        gone.append(language)
    if failed:
        batch = batch.where(F.col("target_language").isin(gone))
    return Distilled(rules, st.processed(feedback, batch.select("id", "diff_data")), batch, known, outcome(seen.get["n"], size, failed))


@dataclass
class Translated:
    #: content_type, id, target_language, strings, translated, error and whether it succeeded, of the cells that the run got to
    results: DataFrame
    #: what is to be stored, by content type and language
    drafts: dict[tuple[str, str], DataFrame]
    queue: DataFrame
    states: DataFrame
    #: queue_id and target_language of the cells that went to review
    cells: DataFrame
    #: the standard forms with those that were learned
    forms: DataFrame
    outcome: str


def outcome(done: int, size: int, stopped: bool) -> str:
    """What a scheduled run reports: an error if it was stopped, again at once after a full batch, else done."""
    return "error" if stopped else "resume" if done == size else "done"


def answered(work: DataFrame, rules: DataFrame, forms: DataFrame, own: Sequence, source: str, limit: int = FAILURES, most: int = WAVE) -> tuple[list[DataFrame], DataFrame, int, bool]:
    """Ask providers for cells (seq from 1 without gaps, content_type, id, target_language, strings) until so many failures on end.

    Cells are asked in waves, each written before the next one begins. The first wave, and one behind a wave that ended in failures, is as wide as
    further failures would end the run; others are twice as wide as the one before, up to ``most`` cells that are asked side by side. Answers behind
    the cell that ends the run are left out, so the result is that of asking one after another. Gives answers by wave, the forms known then, the number of successes, and whether it ended early.
    """
    waves: list[DataFrame] = []
    n = work.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    at, streak, width, good = 0, 0, limit, 0
    published = ru.published(rules)
    stems = needs_forms(published)
    while at < n and streak < limit:
        wave = work.where(F.col("seq").between(at + 1, at + width))
        texts = wave.select(F.col("seq").alias("item_id"), "target_language", tx.plain_text(F.array_join(F.map_values("strings"), " ")).alias("text"))
        forms = normalised(texts, forms, own, source) if stems else forms
        guide = ru.guidance(ru.selected(texts, published, forms if stems else None)).withColumnRenamed("item_id", "seq")
        asked = wave.join(guide, ["seq", "target_language"], "left").withColumn("guidance", F.coalesce("guidance", F.lit("")))
        answers = written(providers.translate(asked.repartition(min(width, n - at), "seq"), own, source, ["seq"]), "answers")
        last = at + width
        for seq, error in answers.select("seq", "error").orderBy("seq").collect():  # a wave's numbers
            streak = streak + 1 if error is not None else 0
            good += error is None
            if streak == limit:
                last = seq
                break
        waves.append(answers.where(F.col("seq") <= last))
        at, width = last, (limit - streak if streak else min(most, 2 * max(width, limit)))
    return waves, forms, good, streak >= limit


def translated(items: DataFrame, queue: DataFrame, states: DataFrame, rules: DataFrame, forms: DataFrame, history: DataFrame, languages: list[tuple[str, str, int]], own: Sequence, source: str, size: int = 5, associations: DataFrame | None = None) -> Translated:
    """One translating run over the next cells of the queue. Two failures on end stop it: cells behind them stay untouched.

    What was translated becomes a draft and goes to review, with the newest version of its item (history: item_id as alias and id,
    version_id; 0 without one), the draft's values (if states have a column for them) and a row in the queue.
    """
    strings = None
    for name in ct.TYPES:
        p = ct.properties(name)
        part = items.where(F.col("content_type") == name).select("content_type", "id", maps.strings(p["fields"], p["json_fields"]).alias("strings"))
        strings = part if strings is None else strings.unionByName(part)
    cells = qu.next_batch(qu.untranslated(items, queue, states, languages, source), size)
    place = F.row_number().over(Window.orderBy("type_rank", "lang_rank", "id")).cast("bigint")  # of a batch's cells
    work = written(cells.withColumn("seq", place).join(strings, ["content_type", "id"]), "work")
    waves, known, n, stopped = answered(work, rules, forms, own, source)
    made = functools.reduce(DataFrame.unionByName, waves) if waves else None
    made = made.drop("target_language") if made is not None else work.select("seq", F.lit(None).cast("map<string,string>").alias("translated"), F.lit("").alias("error")).where("false")
    results = work.join(made, "seq").withColumn("ok", F.isnull("error"))
    good = results.where("ok")
    every = items.select("content_type", "id", "language", "state")
    linked = associations if associations is not None else _unlinked(items)
    stored, shots = {}, None
    for kind, language in sorted(tuple(r) for r in good.select("content_type", "target_language").distinct().collect()):
        own_ = good.where((F.col("content_type") == kind) & (F.col("target_language") == language)).select("id", "translated")
        stored[kind, language] = draft = dr.drafts(items, own_, kind, language, source, linked, every)
        shot = dr.snapshot(draft, kind).select(F.lit(kind).alias("content_type"), F.col("source_id").alias("id"), F.col("language").alias("target_language"), "machine_draft")
        shots = shot if shots is None else shots.unionByName(shot)
    queue = st.ensured(queue, good.select("content_type", F.col("id").alias("content_id")))
    placed = good.join(queue.select("content_type", F.col("content_id").alias("id"), F.col("id").alias("queue_id")), ["content_type", "id"])
    placed = placed.join(shots, ["content_type", "id", "target_language"], "left") if shots is not None else placed.withColumn("machine_draft", F.lit(None).cast("string"))
    changes = placed.join(asc.item_versions(history), ["content_type", "id"], "left").select("queue_id", "target_language", F.coalesce("version_id", F.lit(0)).cast("bigint").alias("source_version_id"), "machine_draft")
    return Translated(results, stored, queue, st.reviewed(states, changes), changes.select("queue_id", "target_language"), known, outcome(n, size, stopped))


def scheduled_translation(store: Store, items: DataFrame, rules: DataFrame, history: DataFrame, languages: list[tuple[str, str, int]], own: Sequence, source: str, size: int = 5, associations: DataFrame | None = None, keep: Callable[[int, Translated], None] = lambda number, run: None) -> list[str]:
    """Translating runs until one ends short of a full batch; their outcomes. store: keeps queue, states and forms (see ``kept``).

    A run's changes are one commit under its number, so a schedule that was killed goes on behind its last complete run. keep: gets each run's number and
    results, to store the drafts, before the commit; a run that is repeated comes with the same number.
    """
    outcomes: list[str] = []
    while not outcomes or outcomes[-1] == "resume":
        last = store.last("translating")
        number = 0 if last is None else last + 1
        queue, states, forms = (store.read(t) for t in ("queue", "states", "forms"))
        run = translated(items, queue, states, rules, forms, history, languages, own, source, size, associations)
        keep(number, run)
        new = run.queue.join(queue.select("id"), "id", "left_anti")
        cells = written(run.states.join(run.cells, ["queue_id", "target_language"], "left_semi"), "cells")
        store.commit("translating", number, {"queue": (new, None), "states": (cells, None), "forms": (_learned(run.forms, forms), None)})
        outcomes.append(run.outcome)
    return outcomes


def scheduled_distilling(store: Store, own: Sequence, source: str, size: int = 20) -> list[str]:
    """Distilling runs until one ends short of a full batch; their outcomes. store: keeps feedback, rules and forms."""
    outcomes: list[str] = []
    while not outcomes or outcomes[-1] == "resume":
        last = store.last("distilling")
        feedback, rules, forms = (store.read(t) for t in ("feedback", "rules", "forms"))
        run = distilled(feedback, rules, forms, own, source, size)
        done = written(run.feedback.join(run.batch.select("id"), "id", "left_semi"), "processed")
        cells = written(run.rules.exceptAll(rules), "changed_rules")
        store.commit("distilling", 0 if last is None else last + 1, {"feedback": (done, None), "rules": (cells, None), "forms": (_learned(run.forms, forms), None)})
        outcomes.append(run.outcome)
    return outcomes


def kept(**tables: DataFrame) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """Tables for a store by name: queue, states, forms, feedback, rules."""
    keys = {"queue": ["content_type", "content_id"], "states": ["queue_id", "target_language"], "forms": ["language", "word"], "feedback": ["id"], "rules": ["id"]}
    return {n: (df.select("language", "word", "standard_form") if n == "forms" else df, keys[n], keys[n][:1] if n == "states" else keys[n]) for n, df in tables.items()}


def _learned(forms: DataFrame, before: DataFrame) -> DataFrame:
    """Forms that weren't there, one a word."""
    return forms.join(before.select("language", "word"), ["language", "word"], "left_anti").dropDuplicates(["language", "word"])


def _unlinked(items: DataFrame) -> DataFrame:
    return items.select("id", F.lit("").alias("context"), F.lit("").alias("key")).where("false")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def menus_for(menus: DataFrame, wanted: DataFrame, source: str) -> DataFrame:
    """Menus (menutype, title, client_id) with those added that hold the drafts' languages (menutype, title, target_language)."""
    named = wanted.select(tx.language_menu(F.col("menutype"), source, F.col("target_language")).alias("menutype"), F.concat("title", F.lit(" ("), "target_language", F.lit(")")).alias("title"), F.lit(0).alias("client_id"))
    return menus.unionByName(named.dropDuplicates(["menutype"]).join(menus, "menutype", "left_anti").select("menutype", "title", "client_id"))


def backfilled(associations: DataFrame, items: DataFrame, queue: DataFrame, states: DataFrame, content_type: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Queue and states seeded from the associations there are, once, when the engine is installed."""
    plan = asc.backfill(associations, items, source)
    queue = st.ensured(queue, plan.select(F.lit(content_type).alias("content_type"), F.col("source_id").alias("content_id")))
    ids = queue.where(F.col("content_type") == content_type).select(F.col("content_id").alias("source_id"), F.col("id").alias("queue_id"))
    wanted = plan.join(ids, "source_id").select("queue_id", F.col("language").alias("target_language"), F.col("state").alias("translation_state"))
    return queue, st.seeded(states, wanted)
