"""The translation queue: what needs translating, the grid of states, and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoloom.functions import text as tx
from lingoloom.sources import content_types as ct

TRASHED, PUBLISHED = -2, 1
NONE = "__none__"
PAGE = 25


def target_languages(languages: DataFrame, source: str, chosen: list[str] | None = None) -> DataFrame:
    """Published languages that are real and not the source, in order; narrowed to the chosen ones."""
    own = languages.where((F.col("published") == 1) & (F.col("lang_code") != "*") & (F.col("lang_code") != source))
    return (own.where(F.col("lang_code").isin(chosen)) if chosen else own).orderBy("ordering", "lang_code")


def picker(languages: DataFrame, source: str) -> DataFrame:
    """The languages that a rule can be for: all but the source, "all languages" and the empty one, in order."""
    return languages.where(~F.col("lang_code").isin("", "*", source)).select(F.col("lang_code").alias("value"), F.col("title").alias("label"), "ordering").orderBy("ordering", "value")


def language_list(languages: DataFrame, source: str, chosen: list[str] | None = None) -> list[tuple[str, str, int]]:
    """The same on the driver: (code, title, ordering). A site's languages are few."""
    return [(r.lang_code, r.title, r.ordering) for r in target_languages(languages, source, chosen).collect()]


def source_title(languages: DataFrame, source: str) -> DataFrame:
    """The source language's title; its code if it has none."""
    one = languages.sparkSession.createDataFrame([(source,)], "lang_code string")
    return one.join(F.broadcast(languages.select("lang_code", "title")), "lang_code", "left").select("lang_code", F.coalesce(F.nullif("title", F.lit("")), "lang_code").alias("title"))


def in_scope(extension: Column, client: Column) -> Column:
    """Whether an item belongs to those its type manages (a condition on content_type, extension and client)."""
    bad = F.lit(False)
    for name, p in ct.TYPES.items():
        own = F.col("content_type") == name
        if "extension" in p:
            bad = bad | (own & (extension != p["extension"]))
        if "client" in p:
            bad = bad | (own & (client != p["client"]))
    return ~bad


def source_item(items: DataFrame, id_: int) -> DataFrame:
    """The whole row of one item; an item that isn't there is an error when the result is used."""
    own = items.where(F.col("id") == id_)
    # the condition is a filter's, which no pruning of columns takes away
    none = own.agg(F.count("*").alias("_n")).where((F.col("_n") == 0) & F.isnotnull(F.raise_error(F.lit(f"source item {int(id_)} not found"))))
    return own.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in items.schema]))


def item_or_none(items: DataFrame | None, id_: int) -> DataFrame | None:
    """The row of one item, or no row; none without a table or for an id that can't be."""
    return None if items is None or id_ <= 0 else items.where(F.col("id") == id_).limit(1)


def present(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """The items (content_type, id) that are wanted, with all their columns; a wanted one that isn't there is an error that names it."""
    found = wanted.select("content_type", "id").distinct().join(items.withColumn("_there", F.lit(True)), ["content_type", "id"], "left")
    name = F.concat(F.lit("source item "), "content_type", F.lit(" "), F.col("id").cast("string"), F.lit(" not found"))
    return found.where(F.when(F.isnull("_there"), F.raise_error(name).cast("boolean")).otherwise(True)).drop("_there").select(items.columns)


def source_items(items: DataFrame, source: str) -> DataFrame:
    """Items in the source language that are not trashed and are in scope."""
    return items.where((F.col("language") == source) & (F.col("state") != TRASHED) & in_scope(F.col("extension"), F.col("client_id")))


def with_flag(items: DataFrame, queue: DataFrame) -> DataFrame:
    """Add queue_id and do_not_translate (null where the item isn't queued)."""
    q = queue.select(F.col("id").alias("queue_id"), "content_type", F.col("content_id").alias("id"), "do_not_translate")
    return items.join(q, ["content_type", "id"], "left")


def untranslated(items: DataFrame, queue: DataFrame, states: DataFrame, languages: list[tuple[str, str, int]], source: str) -> DataFrame:
    """(content_type, id, target_language, type_rank, lang_rank): not opted out, and no state or a pending one."""
    own = with_flag(source_items(items, source).select("content_type", "id", "extension", "client_id"), queue)
    own = own.where(F.coalesce("do_not_translate", F.lit(0)) == 0)
    targets = F.array(*[F.struct(F.lit(code).alias("target_language"), F.lit(rank).alias("lang_rank")) for rank, (code, _, _) in enumerate(languages)])
    cells = own.select("content_type", "id", "queue_id", F.inline(targets)) if languages else own.select("content_type", "id", "queue_id", F.lit("").alias("target_language"), F.lit(0).alias("lang_rank")).where("false")
    st = states.select("queue_id", "target_language", "translation_state")
    cells = cells.join(st, ["queue_id", "target_language"], "left").where("translation_state is null or translation_state = 'pending'")
    rank = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(ct.dependency_order()) for x in (n, i)]), F.col("content_type"))
    return cells.select("content_type", "id", "target_language", rank.alias("type_rank"), "lang_rank")


def next_batch(cells: DataFrame, size: int) -> DataFrame:
    """The first cells by type (those referred to first), language and id: one distributed top-k."""
    return cells.orderBy("type_rank", "lang_rank", "id").limit(size)


def reject_reason(items: DataFrame, queue: DataFrame, target: str) -> DataFrame:
    """Why an item may not be translated into a language (null if it may)."""
    own = with_flag(items, queue)
    reason = F.when(~in_scope(F.col("extension"), F.col("client_id")), "scope").when(F.col("language") == "*", "all-languages").when(F.col("language") == target, "same-language").when(F.coalesce("do_not_translate", F.lit(0)) != 0, "opted-out")
    return own.select("content_type", "id", reason.alias("reject_reason"))


def opted(items: DataFrame, mode: str = "") -> DataFrame:
    """Filter by the opt-out flag: hidden by default, ``show`` all, ``only`` opted out."""
    flag = F.coalesce("do_not_translate", F.lit(0))
    return items if mode == "show" else items.where(flag == 1) if mode == "only" else items.where(flag == 0)


def with_status(items: DataFrame, queue: DataFrame, states: DataFrame, wanted: list[str]) -> DataFrame:
    """Items with any state of the wanted ones, or (NONE) without a state in any language. Existence joins under an OR."""
    if not wanted:
        return items
    cells = queue.select(F.col("id").alias("queue_id"), "content_type", "content_id").join(states.select("queue_id", "translation_state"), "queue_id")
    listed = [s for s in wanted if s != NONE]
    hit = F.max(F.col("translation_state").isin(listed).cast("int")) if listed else F.lit(0)
    found = cells.groupBy("content_type", F.col("content_id").alias("id")).agg(hit.alias("_hit"))
    out = items.join(found, ["content_type", "id"], "left")
    keep = F.coalesce("_hit", F.lit(0)) == 1
    return out.where(keep | F.isnull("_hit") if NONE in wanted else keep).drop("_hit")


def like_pattern(search: str, escape: bool = True) -> str:
    """What a title search looks for: blanks stand for anything; with ``escape``, % and _ and backslashes for themselves."""
    own = search.strip()
    if escape:
        own = own.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return "%" + own.replace(" ", "%").lower() + "%"


def search_id(search: str) -> int | None:
    """The id of an "id:n" search: leading digits, else 0; null for another search."""
    import re

    if not search.lower().startswith("id:"):
        return None
    m = re.match(r"\s*[+-]?\d+", search[3:])
    return int(m[0]) if m else 0


def searched(items: DataFrame, search: str, columns: list[str], escape: bool = True) -> DataFrame:
    """By id, or by a pattern in any of the columns, without regard to case and accents; nothing to look for filters nothing."""
    if not search or search == "0":
        return items
    if (n := search_id(search)) is not None:
        return items.where(F.col("id") == n)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.call_function("like", tx.folded(F.col(c)), tx.folded(F.lit(like_pattern(search, escape)))), F.lit(False))
    return items.where(hit)


def page(items: DataFrame, order: str, direction: str = "asc", allowed: tuple[str, ...] = ("title", "id"), start: int = 0, size: int = PAGE) -> DataFrame:
    """A page in a whitelisted order, ties by id."""
    by = order if order in allowed else allowed[0]
    return items.orderBy(F.col(by).desc() if direction.lower() == "desc" else F.col(by).asc(), F.col("id")).offset(start).limit(size)


def last_states(queue: DataFrame, states: DataFrame) -> DataFrame:
    """(content_type, id, target_language, translation_state): the state with the largest id wins."""
    cells = queue.select(F.col("id").alias("queue_id"), "content_type", F.col("content_id")).join(states.select(F.col("id").alias("state_id"), "queue_id", "target_language", "translation_state"), "queue_id")
    return cells.groupBy("content_type", F.col("content_id").alias("id"), "target_language").agg(F.max_by("translation_state", "state_id").alias("translation_state"))


def state_maps(queue: DataFrame, states: DataFrame) -> DataFrame:
    """(content_type, id, states): map of language to state."""
    return last_states(queue, states).groupBy("content_type", "id").agg(F.map_from_entries(F.collect_list(F.struct("target_language", "translation_state"))).alias("states"))


def grid(items: DataFrame, queue: DataFrame, states: DataFrame, languages: list[str], source: str, mode: str = "") -> DataFrame:
    """Items by languages: one state column a language. One plan: the map is made before the join, and columns are looked up in it."""
    own = opted(with_flag(source_items(items, source).select("content_type", "id", "title", "language", "state", "extension", "client_id"), queue), mode)
    out = own.join(state_maps(queue, states), ["content_type", "id"], "left")
    return out.select("content_type", "id", "title", "state", F.coalesce("do_not_translate", F.lit(0)).alias("do_not_translate"), *[F.element_at("states", F.lit(x)).alias(x.replace("-", "_")) for x in languages])


def cell_actions(state: Column, live: Column) -> dict[str, Column]:
    """What a cell offers: editing, translating, and a marker if its item is live against its state (or the reverse)."""
    return {
        "editable": F.coalesce(state.isin("review", "approved"), F.lit(False)),
        "translatable": state.isNull() | (state == "pending"),
        "live_marker": F.coalesce(live, F.lit(False)) != F.coalesce(state == "published", F.lit(False)),
    }


def may_edit(checked_out: Column, user: int) -> Column:
    """Whether nobody, or this user, has the item checked out."""
    return F.coalesce(checked_out, F.lit(0)).isin(0, user)
