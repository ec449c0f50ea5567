"""The engine's tables, derived from the driver's Parquet tables by rules that DuckDB can repeat (see oracle_tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SOURCE_LANGUAGE = "en-GB"

LANGUAGE = "CASE lang WHEN 'en' THEN 'en-GB' WHEN 'fr' THEN 'fr-FR' WHEN 'de' THEN 'de-DE' WHEN 'es' THEN 'es-ES' ELSE '*' END"
STATE = "CASE {0} % 10 WHEN 0 THEN -2 WHEN 1 THEN 0 ELSE 1 END"

#: Statements that mean the same to Spark and DuckDB; {tables} are replaced by each engine's names.
SHARED: dict[str, str] = {
    "languages": "SELECT * FROM (VALUES ('en-GB', 'English', 1, 1), ('fr-FR', 'French', 1, 2), ('de-DE', 'German', 1, 3), ('es-ES', 'Spanish', 1, 4), ('it-IT', 'Italian', 0, 5), ('*', 'All', 1, 6)) AS t(lang_code, title, published, ordering)",
    "users": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM {nation}",
    "content_items": f"""
SELECT 'com_content.article' AS content_type, CAST(doc_id AS BIGINT) AS id, substr(text, 1, 40) AS title, {LANGUAGE} AS language, {STATE.format('doc_id')} AS state, concat('article-', doc_id) AS alias,
  'com_content' AS extension, 0 AS client_id, CAST(doc_id % 3 AS BIGINT) AS checked_out, text AS introtext, CASE WHEN doc_id % 4 = 0 THEN concat('more ', source) WHEN doc_id % 4 = 1 THEN '  ' ELSE '' END AS fulltext,
  CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS metadesc, '' AS metakey, CASE WHEN doc_id % 2 = 0 THEN concat('note ', doc_id) END AS note, CAST(NULL AS VARCHAR(100)) AS description,
  CASE WHEN doc_id % 5 = 0 THEN concat('{{"image_intro_alt":"alt ', doc_id, '","image_intro_caption":" ","other":"kept"}}') ELSE '' END AS images, CAST(doc_id % 10 + 1 AS BIGINT) AS catid FROM {{documents}}
UNION ALL
SELECT 'com_tags.tag', CAST(p_partkey AS BIGINT), p_name, 'en-GB', {STATE.format('p_partkey')}, concat('tag-', p_partkey), '', 0, CAST(0 AS BIGINT), NULL, NULL, '', '', NULL, p_name, '', CAST(NULL AS BIGINT) FROM {{part}}
UNION ALL
SELECT 'com_categories.category', CAST(s_suppkey AS BIGINT), s_name, CASE s_suppkey % 5 WHEN 0 THEN 'fr-FR' ELSE 'en-GB' END, {STATE.format('s_suppkey')}, concat('category-', s_suppkey), CASE WHEN s_suppkey % 4 <> 0 THEN 'com_content' ELSE 'other' END, 0,
  CAST(0 AS BIGINT), NULL, NULL, '', '', NULL, s_name, NULL, CAST(NULL AS BIGINT) FROM {{supplier}}
UNION ALL
SELECT 'com_menus.item', CAST(n_nationkey AS BIGINT), n_name, 'en-GB', 1, concat('menu-', n_nationkey), '', CAST(n_nationkey % 2 AS INT), CAST(0 AS BIGINT), NULL, NULL, '', '', NULL, NULL, NULL, CAST(NULL AS BIGINT) FROM {{nation}}""",
    "associations": "SELECT CAST(doc_id AS BIGINT) AS id, 'com_content.item' AS context, md5(concat('g', doc_id - doc_id % 4)) AS key FROM {documents} WHERE doc_id % 13 <> 5",
    "queue": "SELECT CAST(doc_id AS BIGINT) AS id, 'com_content.article' AS content_type, CAST(doc_id AS BIGINT) AS content_id, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS do_not_translate FROM {documents} WHERE lang = 'en' AND doc_id % 3 <> 2",
    "queue_states": """
SELECT CAST(q.id * 10 + l.ordering AS BIGINT) AS id, q.id AS queue_id, l.lang_code AS target_language,
  CASE (q.id + l.ordering) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'translating' WHEN 2 THEN 'review' WHEN 3 THEN 'approved' ELSE 'published' END AS translation_state, CAST(q.id * 7 % 100 AS BIGINT) AS source_version_id
FROM {queue} q JOIN {languages} l ON l.ordering IN (2, 3, 4) AND (q.id + l.ordering) % 2 = 0""",
    "history": "SELECT concat('com_content.article.', user_id) AS item_id, CAST(event_id AS BIGINT) AS version_id FROM {events}",
    "tag_map": "SELECT 'com_content.article' AS type_alias, CAST(doc_id AS BIGINT) AS content_item_id, CAST(doc_id % 50 + k AS BIGINT) AS tag_id FROM {documents} JOIN (VALUES (1), (8)) AS t(k) ON doc_id % 2 = 0",
    "item_fields": """
SELECT 'com_content.article' AS content_type, CAST(doc_id AS BIGINT) AS item_id, CAST(f.field_id AS BIGINT) AS field_id, f.name AS name, f.type AS type, CASE WHEN (doc_id + f.field_id) % 3 = 0 THEN ' ' ELSE concat(f.name, ' of ', source) END AS value
FROM {documents} JOIN (VALUES (1, 'subtitle', 'text'), (2, 'mood', 'list'), (3, 'teaser', 'textarea')) AS f(field_id, name, type) ON doc_id % 5 = 0""",
    "fields_categories": "SELECT CAST(s_suppkey % 9 AS BIGINT) AS field_id, CAST(s_suppkey AS BIGINT) AS category_id FROM {supplier}",
    "rules": r"""
SELECT CAST(item_id AS BIGINT) AS id, concat('rule ', item_id) AS rule_name, CASE item_id % 3 WHEN 0 THEN 'terminology' WHEN 1 THEN 'style' ELSE 'preservation' END AS rule_type,
  CASE item_id % 4 WHEN 0 THEN 'fr-FR' WHEN 1 THEN 'de-DE' ELSE 'es-ES' END AS target_language, concat('text ', item_id) AS rule_text, {word:2} AS source_term,
  CASE WHEN item_id % 2 = 0 THEN {stem:2} END AS source_term_standard, CASE WHEN item_id % 3 = 0 THEN concat('t', item_id) END AS target_term, concat({word:3}, ', ', {word:4}, ';of') AS search_keywords,
  CAST(item_id % 101 AS INT) AS confidence_percent, CASE item_id % 5 WHEN 0 THEN 0 WHEN 4 THEN -2 ELSE 1 END AS state, CAST(item_id % 7 AS INT) AS ordering, CAST(item_id % 25 AS BIGINT) AS checked_out,
  CASE WHEN item_id % 2 = 0 THEN 'distilled' ELSE 'manual' END AS source_origin FROM {benchmark}""",
    "standard_forms": "SELECT DISTINCT 'en-GB' AS language, w AS word, CASE WHEN w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END AS standard_form FROM (SELECT {tokens:text} AS w FROM {benchmark}) t WHERE length(w) >= 3",
    "feedback": """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, CASE conv_id % 3 WHEN 0 THEN 'fr-FR' WHEN 1 THEN 'de-DE' ELSE 'es-ES' END AS target_language, text AS source_text, text AS machine_draft, next_text AS human_correction,
  CASE WHEN conv_id % 4 <> 0 THEN 'pending' ELSE 'processed' END AS status, CAST(conv_id % 97 AS INT) AS created_day
FROM (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM {conversations}) t WHERE role = 'user' AND next_role = 'assistant'""",
    "snapshots": """
SELECT s.queue_id, s.target_language, s.translation_state, m.field, CASE m.field WHEN 'title' THEN i.title WHEN 'introtext' THEN i.introtext ELSE i.metadesc END AS draft
FROM {queue_states} s JOIN {content_items} i ON i.id = s.queue_id AND i.content_type = 'com_content.article' JOIN (VALUES ('title'), ('introtext'), ('metadesc')) AS m(field) ON s.queue_id % 2 = 0""",
    "candidates": r"""
SELECT CAST(CASE WHEN item_id % 4 = 1 THEN item_id ELSE 0 END AS BIGINT) AS id, CASE WHEN item_id % 9 = 0 THEN '' ELSE concat('candidate ', item_id) END AS rule_name,
  CASE item_id % 5 WHEN 0 THEN 'terminology' WHEN 1 THEN 'style' WHEN 2 THEN 'preservation' WHEN 3 THEN 'terminology' ELSE 'unknown' END AS rule_type,
  CASE WHEN item_id % 10 = 6 THEN ' ' ELSE concat('new text ', item_id) END AS rule_text, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE concat(' ', {word:2}, ' ') END AS source_term,
  CASE WHEN item_id % 8 = 3 THEN NULL ELSE concat('target ', item_id) END AS target_term, {word:3} AS search_keywords, CAST(item_id * 3 % 150 - 10 AS INT) AS confidence_percent, CAST(item_id + 1 AS BIGINT) AS feedback_id,
  CAST(item_id AS BIGINT) AS seq FROM {benchmark}""",
}

_SPARK = {
    "word": lambda n: rf"regexp_replace(get(split(text, '\\s+'), {int(n) - 1}), '[^\\p{{L}}\\p{{N}}]', '')",
    "stem": lambda n: rf"regexp_replace(lower(regexp_replace(get(split(text, '\\s+'), {int(n) - 1}), '[^\\p{{L}}\\p{{N}}]', '')), 's$', '')",
    "tokens": lambda c: rf"explode(split(lower({c}), '[^\\p{{L}}\\p{{N}}\'-]+'))",
}
DUCK = {
    "word": lambda n: rf"regexp_replace(coalesce(string_split_regex(text, '\s+')[{n}], ''), '[^\p{{L}}\p{{N}}]', '', 'g')",
    "stem": lambda n: rf"regexp_replace(lower(regexp_replace(string_split_regex(text, '\s+')[{n}], '[^\p{{L}}\p{{N}}]', '', 'g')), 's$', '')",
    "tokens": lambda c: rf"unnest(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}''-]+'))",
}
DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")


def rendered(name: str, of: Callable[[str], str], words: dict[str, Callable[[str], str]]) -> str:
    """A shared statement with its tables and word functions filled in."""
    text = SHARED[name]
    for kind, form in words.items():
        while (at := text.find("{" + kind + ":")) >= 0:
            end = text.index("}", at)
            text = text[:at] + form(text[at + len(kind) + 2 : end]) + text[end + 1 :]
    for other in (*DRIVER, *SHARED):
        text = text.replace("{" + other + "}", of(other))
    return text.replace("{{", "{").replace("}}", "}")


class Tables:
    """Lazy access by name: ``t.queue`` or ``t["queue"]``; driver tables are read from sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in SHARED:
                text = rendered(name, lambda other: f"\0{other}\0", _SPARK)
                used = [o for o in (*DRIVER, *SHARED) if f"\0{o}\0" in text]
                text = text.replace("{", "{{").replace("}", "}}")
                for o in used:
                    text = text.replace(f"\0{o}\0", "{" + o + "}")
                self._made[name] = self.spark.sql(text, **{o: self[o] for o in used})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self[name]
