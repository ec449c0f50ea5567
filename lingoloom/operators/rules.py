"""Rules learned from corrections: listing, matching with texts, ranked selection, validation and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoloom.functions import maps, scan
from lingoloom.functions import text as tx

from . import states as st
from .queue import searched

#: Limits of what a translated item gets, and of what a distilling batch gets: of all kinds, and of style rules.
ITEM_RULES, ITEM_STYLE = 30, 10
BATCH_RULES, BATCH_STYLE = 50, 15
KINDS = ["terminology", "style", "preservation"]


def published(rules: DataFrame, language: Column | str | None = None) -> DataFrame:
    """Published rules (of a language)."""
    own = rules.where(F.col("state") == 1)
    return own if language is None else own.where(F.col("target_language") == language)


#: Columns that the list of rules can be ordered by.
ORDERS = ("ordering", "id", "rule_name", "rule_type", "target_language", "confidence_percent", "source_origin", "state")


def listed(rules: DataFrame, languages: DataFrame, users: DataFrame, state: str = "", kind: str = "", language: str = "", origin: str = "", search: str = "", order: str = "ordering", direction: str = "asc") -> DataFrame:
    """The list of rules with their language's title and the editor who has them checked out, in order (ties by id). state: a number, ''
    for drafts and published ones, anything else for all."""
    own = rules
    if state.lstrip("-").isdigit():
        own = own.where(F.col("state") == int(state))
    elif state == "":
        own = own.where(F.col("state").isin(0, 1))
    for column, value in (("rule_type", kind), ("target_language", language), ("source_origin", origin)):
        own = own.where(F.col(column) == value) if value else own
    own = searched(own, search, ["rule_name", "rule_text", "source_term", "target_term"], escape=False)
    titles = languages.select(F.col("lang_code").alias("target_language"), F.col("title").alias("language_title"))
    editors = users.select(F.col("id").alias("checked_out"), F.col("name").alias("editor"))
    by = F.col(order if order in ORDERS else ORDERS[0])
    out = own.join(F.broadcast(titles), "target_language", "left").join(editors, "checked_out", "left")
    return out.orderBy(by.desc() if direction.lower() == "desc" else by.asc(), "id")


def needles(rules: DataFrame) -> DataFrame:
    """(rule_id, target_language, needle): the term, and the search keywords that are long enough, of rules that must match."""
    own = rules.where(F.col("rule_type").isin("terminology", "preservation"))
    terms = F.concat(F.array(F.coalesce("source_term", F.lit(""))), tx.keywords(F.coalesce("search_keywords", F.lit(""))))
    out = own.select(F.col("id").alias("rule_id"), "target_language", F.explode(F.array_distinct(F.transform(terms, tx.one_line))).alias("needle"))
    return out.where("needle <> ''")


def matches(texts: DataFrame, rules: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Distinct (item_id, target_language, rule_id): rules whose term or keyword stands in the item's text as a whole, or
    shares a standard form with one of its words. texts: item_id, text and, if a text is for one language only, target_language.

    Needles, and the words that have a rule's standard form, are found by automata in one pass over each text (functions/scan.py); what was
    found meets the rules in an equi-join.
    """
    own = needles(rules).select("rule_id", "target_language", F.lower("needle").alias("needle"), F.lit(scan.PHRASE).alias("kind"))
    if forms is not None:
        stems = rules.where(F.col("rule_type").isin("terminology", "preservation") & (F.coalesce("source_term_standard", F.lit("")) != ""))
        stems = stems.select(F.col("id").alias("rule_id"), "target_language", F.col("source_term_standard").alias("standard_form"))
        words = stems.join(forms.select("word", "standard_form"), "standard_form").where((F.length("word") >= tx.LEAST) & F.col("word").rlike(rf"^[{tx.INSIDE}'-]+$"))
        own = own.union(words.select("rule_id", "target_language", "word", F.lit(scan.TOKEN)))
    on = ["target_language"] if "target_language" in texts.columns else []
    hit = scan.found(texts.select("item_id", *on, "text"), own)
    return hit.join(own, ["needle", "kind", *on]).select("item_id", "target_language", "rule_id").distinct()


def _items(texts: DataFrame, languages: list[str] | None) -> DataFrame:
    """(item_id, target_language) that get rules."""
    if languages is None:
        return texts.select("item_id", "target_language").distinct()
    return texts.select("item_id").distinct().select("item_id", F.explode(F.array(*map(F.lit, languages))).alias("target_language"))


def selected(texts: DataFrame, rules: DataFrame, forms: DataFrame | None = None, most: int = ITEM_RULES, style: int = ITEM_STYLE, drafts_first: bool = False, any_kind: bool = False, languages: list[str] | None = None) -> DataFrame:
    """(item_id, target_language, rule columns, place): style rules and matching others, best first, within the limits.

    Best is by confidence, then id (before that by state, if drafts_first). Two ranked steps equal the greedy walk: style rules beyond
    their limit never take a place. languages: those wanted, where texts are for all of them. Style rules are cut to their limit before they meet the items.
    """
    order = [F.col("state").asc()] * drafts_first + [F.col("confidence_percent").desc(), F.col("id").desc()]
    own = rules if any_kind else rules.where(F.col("rule_type").isin(KINDS))
    top = own.where("rule_type = 'style'").withColumn("_n", F.row_number().over(Window.partitionBy("target_language").orderBy(*order))).where(F.col("_n") <= style).drop("_n")
    styled = _items(texts, languages).join(F.broadcast(top), "target_language")
    hit = matches(texts, own, forms).join(own.withColumnRenamed("id", "rule_id").drop("target_language"), "rule_id").withColumnRenamed("rule_id", "id")
    hit = hit.where(F.col("target_language").isin(languages)) if languages else hit
    every = styled.unionByName(hit.select(styled.columns))
    place = F.row_number().over(Window.partitionBy("item_id", "target_language").orderBy(*order))
    return every.withColumn("place", place).where(F.col("place") <= most)


def grouped(chosen: DataFrame) -> DataFrame:
    """(item_id, target_language) with a list of rules of each kind in order, empty ones kept."""
    one = F.struct("place", F.coalesce("source_term", F.lit("")).alias("source_term"), F.coalesce("target_term", F.lit("")).alias("target_term"), F.coalesce("rule_text", F.lit("")).alias("rule_text"))
    return chosen.groupBy("item_id", "target_language").agg(*[F.array_sort(F.collect_list(F.when(F.col("rule_type") == k, one))).alias(k) for k in KINDS])


_HEADS = {"terminology": "Terminology:", "style": "Style:", "preservation": "Keep unchanged:"}


def guidance(chosen: DataFrame) -> DataFrame:
    """(item_id, target_language, guidance): a section for each kind that has rules; a rule by its text, else by its terms."""
    sections = []
    for k in KINDS:
        def line(r: Column) -> Column:
            pair = F.when(r.target_term != "", F.concat(r.source_term, F.lit(" = "), r.target_term)).otherwise(r.source_term)
            return F.concat(F.lit("- "), F.when(tx.trimmed(r.rule_text) != "", r.rule_text).otherwise(pair))

        sections.append(F.when(F.size(k) > 0, F.concat_ws("\n", F.array(F.lit(_HEADS[k])), F.transform(k, line))))
    return grouped(chosen).select("item_id", "target_language", F.concat_ws("\n\n", *sections).alias("guidance"))


def checked(rows: DataFrame) -> DataFrame:
    """Validate and put into canonical form: rule_error (null if valid), and the columns of a kind that don't apply blanked."""
    blank = lambda c: tx.trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    kind = F.col("rule_type")
    error = (
        F.when(blank("rule_name"), "name")
        .when(~kind.isin(KINDS), "type")
        .when((kind == "terminology") & (blank("source_term") | blank("target_term")), "terms")
        .when((kind == "preservation") & blank("source_term"), "term")
        .when((kind == "style") & blank("rule_text"), "text")
    )
    style = kind == "style"
    return rows.withColumns({
        "rule_error": error, "source_term": F.when(style, "").otherwise(F.col("source_term")), "target_term": F.when(kind.isin("style", "preservation"), "").otherwise(F.col("target_term")),
        "search_keywords": F.when(style, "").otherwise(F.col("search_keywords")), "confidence_percent": F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence_percent"))),
    })


def with_standard_terms(rules: DataFrame, forms: DataFrame) -> DataFrame:
    """Set source_term_standard: the form of a term of one word, null for phrases and unknown words. Words are looked up as the tables compare
    them, without regard to case and accents."""
    term = F.when(tx.is_single_word(F.col("source_term")), tx.folded(tx.one_line(F.col("source_term"))))
    own = forms.groupBy(tx.folded(F.col("word")).alias("_w")).agg(F.min("standard_form").alias("_f"))
    return rules.withColumn("_t", term).join(own, F.col("_t") == F.col("_w"), "left").withColumn("source_term_standard", F.col("_f")).drop("_t", "_w", "_f")


def upserted(rules: DataFrame, candidates: DataFrame, language: str, forms: DataFrame | None = None, user: int | None = None) -> DataFrame:
    """Rules after a batch of candidates (id, rule_name ... confidence_percent, feedback_ids, seq), invalid ones left out.

    A candidate with a rule's id refines it: texts are replaced, confidence never drops, evidence is added, state and
    origin stay; of some with one id, the last counts, with all evidence. The others are new drafts with new ids and orderings. All
    columns stay, but those of the audit (if rules have them) are stamped with the time and the user; terms that were stated anew have the standard form that ``forms`` (word, standard_form) give. rules: as listed,
    with source_feedback_ids, an array or a JSON list.
    """
    if dict(rules.dtypes)["source_feedback_ids"] == "string":
        rules = rules.withColumn("source_feedback_ids", maps.ids_of_json(F.col("source_feedback_ids")))
    own = checked(candidates.withColumns({c: tx.nullable(F.col(c)) for c in ("source_term", "target_term")})).where("rule_error is null")
    known = rules.where("id > 0").select(F.col("id").alias("_id"))
    if forms is not None:
        own = with_standard_terms(own, forms)
    elif "source_term_standard" not in own.columns:
        own = own.withColumn("source_term_standard", F.lit(None).cast("string"))
    marked = own.join(known, F.col("id") == F.col("_id"), "left")
    fields = ["rule_name", "rule_type", "rule_text", "source_term", "source_term_standard", "target_term", "search_keywords"]
    fields = [f for f in fields if f in rules.columns]
    newest = F.max_by(F.struct(*fields), "seq").alias("new")
    refine = marked.where("_id is not null").groupBy("id").agg(newest, F.max("confidence_percent").alias("_c"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "feedback_ids"))), lambda x: x.feedback_ids))).alias("_f"))
    out = rules.join(refine, "id", "left")
    changed = F.isnotnull("new")
    out = out.withColumns({
        **{c: F.when(changed, F.col(f"new.{c}")).otherwise(F.col(c)) for c in fields}, "target_language": F.when(changed, F.lit(language)).otherwise(F.col("target_language")),
        "confidence_percent": F.greatest("confidence_percent", F.coalesce("_c", "confidence_percent")), "source_feedback_ids": maps.merged_ids(F.col("source_feedback_ids"), F.col("_f")),
    })
    audited = "modified" in rules.columns
    out = (st.stamped(out, user, new=False, changed=changed) if audited else out).select(rules.columns)
    fresh = marked.where("_id is null")
    # the batch of a distilling run is small (its size is a parameter of the run), so one window numbers it
    last = [F.coalesce(F.max(c), F.lit(0)) for c in ("id", "ordering") if c in rules.columns]
    top = rules.agg(*last).first()  # two numbers
    place = F.row_number().over(Window.orderBy("seq"))
    made = {"id": F.lit(top[0]) + place, "target_language": F.lit(language), "source_feedback_ids": F.array_distinct("feedback_ids"), "state": F.lit(0), "source_origin": F.lit("distilled")}
    made |= {"ordering": F.lit(top[1]) + place} if len(top) > 1 else {}
    kept = {c: F.col(c) for c in (*fields, "confidence_percent")}
    blank = lambda f: F.lit(None)
    fresh = fresh.select(*[(made.get(f.name) if f.name in made else kept.get(f.name, blank(f))).cast(f.dataType).alias(f.name) for f in rules.schema])
    return out.unionByName(st.stamped(fresh, user).select(rules.columns) if audited else fresh)


def new_rule(rows: DataFrame, rules: DataFrame, user: int | None = None) -> DataFrame:
    """Defaults of rules made by hand: the next orderings, full confidence where it is 0, a text, and (if rules have them) who made them when."""
    top = rules.agg(F.coalesce(F.max("ordering"), F.lit(0))).first()[0]  # one number
    out = rows.withColumn("_n", F.row_number().over(Window.orderBy("id")))  # those made by hand at once
    confidence = F.when(F.coalesce("confidence_percent", F.lit(0)) == 0, 100).otherwise(F.col("confidence_percent"))
    out = out.withColumns({"ordering": (F.lit(top) + F.col("_n")).cast("int"), "confidence_percent": confidence, "rule_text": F.coalesce("rule_text", F.lit(""))}).drop("_n")
    return st.stamped(out, user) if "modified" in rules.columns else out
