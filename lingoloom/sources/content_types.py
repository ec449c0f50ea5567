"""The content types: what of an item is translated, and how its versions, associations and relations are named."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_KEYS = ["image_intro_alt", "image_intro_caption", "image_fulltext_alt", "image_fulltext_caption"]

#: The shipped content types.
TYPES: dict[str, dict] = {
    "com_content.article": {
        "table": "#__content", "fields": ["title", "introtext", "fulltext", "metadesc", "metakey", "note"], "json_fields": {"images": IMAGE_KEYS}, "version_alias": "com_content.article",
        "form": "com_content.article", "association_context": "com_content.item", "copy": ["catid", "access", "created_by"], "state_field": "state", "associated": {"catid": "com_categories.category"}, "many": {"tags": "com_tags.tag"},
    },
    "com_categories.category": {
        "table": "#__categories", "fields": ["title", "note", "description", "metadesc", "metakey"], "json_fields": {}, "version_alias": "com_content.category", "form": "com_categories.categorycom_content",
        "association_context": "com_categories.item", "copy": ["parent_id", "extension", "access", "created_user_id"], "tags_as": "com_content.category", "state_field": "published", "extension": "com_content", "associated": {}, "many": {"tags": "com_tags.tag"},
    },
    "com_tags.tag": {
        "table": "#__tags", "fields": ["title", "note", "description", "metadesc", "metakey"], "json_fields": {"images": IMAGE_KEYS}, "version_alias": "com_tags.tag", "form": "com_tags.tag",
        "association_context": "com_tags.item", "copy": ["parent_id", "access", "created_user_id"], "state_field": "published", "self_associated": True, "associated": {}, "many": {},
    },
    "com_menus.item": {
        "table": "#__menu", "fields": ["title"], "json_fields": {}, "form": "com_menus.item", "association_context": "com_menus.item", "copy": ["link", "type", "component_id", "browserNav", "access", "img", "template_style_id", "params"], "state_field": "published", "client": 0,
        "force": {"home": 0, "parent_id": 1}, "language_menu": "menutype", "associated": {}, "many": {},
    },
}


#: The properties of a map of content types in JSON, and what they are called here.
_NAMES = {
    "versionTypeAlias": "version_alias", "optOutForm": "form", "context_associations": "association_context", "draftCopyFields": "copy", "context_tags": "tags_as", "stateField": "state_field",
    "limitToExtension": "extension", "limitToClient": "client", "draftForceFields": "force", "languageMenu": "language_menu", "associatedFields": "associated", "m2m_relation": "many", "table": "table",
}


def of_json(text: str) -> dict[str, dict]:
    """The types of a map in JSON ({"contentTypes": {type: properties}}); text without such a map has none.

    A translatable field that is an object is a JSON column with the keys of it that are translated. Lists and maps that a type lacks are
    empty, its form is null, and a property without a name here is left out.
    """
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    found = found.get("contentTypes") if isinstance(found, dict) else None
    types = {}
    for name, given in (found if isinstance(found, dict) else {}).items():
        fields = given.get("translatableFields", [])
        own = {"fields": [f for f in fields if isinstance(f, str)], "json_fields": {c: keys for f in fields if isinstance(f, dict) for c, keys in f.items()}}
        own |= {"form": None, "association_context": "", "copy": [], "associated": {}, "many": {}} | {here: given[there] for there, here in _NAMES.items() if there in given}
        types[name] = own | ({"self_associated": True} if given.get("associationsByModel") is False else {})
    return types


def load(spark: SparkSession, path: str) -> dict[str, dict]:
    """Read a map of content types from a JSON file that the driver reaches, and put it in place of the shipped one for all operators.
    A missing file is an error, and the types stay as they are."""
    types = of_json("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    TYPES.clear()
    TYPES.update(types)
    return TYPES


def items(tables: dict[str, DataFrame]) -> DataFrame:
    """content_items from the host's own tables, by the name that a type's map gives its table: each row with its content_type, its type's
    state column as state, and columns that a table lacks as null. Types without a table among them, or without a state column, have no rows."""
    out = None
    for name, p in TYPES.items():
        table, state = tables.get(p.get("table", "")), p.get("state_field", "")
        if table is None or state not in table.columns:
            continue
        rest = [c for c in table.columns if c not in (state, "state", "content_type")]
        part = table.select(F.lit(name).alias("content_type"), F.col(state).alias("state"), *rest)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the tables is that of a content type")
    return out


def host_rows(drafts: DataFrame, content_type: str) -> DataFrame:
    """Drafts as rows for the host's table: state under the name that the type's table has for it."""
    return drafts.withColumnRenamed("state", properties(content_type)["state_field"])


def versioned() -> list[str]:
    """The types that keep versions."""
    return [n for n, p in TYPES.items() if p.get("version_alias")]


def version_aliases() -> list[str]:
    return [TYPES[n]["version_alias"] for n in versioned()]


def self_associated() -> list[str]:
    """The types whose associations the engine keeps itself."""
    return [n for n, p in TYPES.items() if p.get("self_associated")]


def properties(content_type: str) -> dict:
    """A type's properties; an unknown type is an error."""
    if content_type not in TYPES:
        raise ValueError(f"unknown content type: {content_type}")
    return TYPES[content_type]


def by_version_alias(alias: str) -> str | None:
    """The first type whose versions carry this alias."""
    return next((name for name, p in TYPES.items() if p.get("version_alias") == alias), None)


def by_form(form: str) -> str | None:
    """The first type whose opt-out switch is on this form."""
    return next((name for name, p in TYPES.items() if p["form"] == form), None)


def related(content_type: str) -> list[str]:
    """The types that a type's items refer to, each once."""
    p = properties(content_type)
    return list(dict.fromkeys([*p["associated"].values(), *p["many"].values()]))


def dependency_order(types: dict[str, dict] | None = None) -> list[str]:
    """Types so that those referred to come first; depth first, and a cycle is cut where it closes."""
    own = TYPES if types is None else types
    done: dict[str, None] = {}
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done or name in open_ or name not in own:
            return
        open_.add(name)
        p = own[name]
        for other in dict.fromkeys([*p.get("associated", {}).values(), *p.get("many", {}).values()]):
            visit(other)
        done[name] = None

    for name in own:
        visit(name)
    return list(done)


def type_table(spark: SparkSession) -> DataFrame:
    """content_type, version_alias, association_context, type_rank (dependency order), extension and client."""
    rows = [(n, TYPES[n].get("version_alias"), TYPES[n]["association_context"], i, TYPES[n].get("extension"), TYPES[n].get("client")) for i, n in enumerate(dependency_order())]
    return spark.createDataFrame(rows, "content_type string, version_alias string, association_context string, type_rank int, extension string, client int")
