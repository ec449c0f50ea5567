"""DuckDB SQL of the queries that SQL can express. {name} stands for a derived table."""

from __future__ import annotations

import re

from .oracle_tables import with_tables

_RANK = "CASE i.content_type WHEN 'com_tags.tag' THEN 0 WHEN 'com_categories.category' THEN 1 WHEN 'com_content.article' THEN 2 ELSE 3 END"
_SCOPE = "(i.content_type <> 'com_categories.category' OR i.extension = 'com_content') AND (i.content_type <> 'com_menus.item' OR i.client_id = 0)"
_SOURCE = f"i.language = 'en-GB' AND i.state <> -2 AND {_SCOPE}"
_GROUPS = """g AS (SELECT a.id, b.id AS member_id, i.language, i.state FROM {associations} a JOIN {associations} b ON a.context = b.context AND a.key = b.key
  JOIN {content_items} i ON i.id = b.id AND i.content_type = 'com_content.article')"""
_TO = "r AS (SELECT id, max(member_id) AS member_id FROM g WHERE member_id <> id AND language = 'fr-FR' GROUP BY id)"
_PLAN = """m AS (SELECT a.context, a.key, i.id, i.language, i.state FROM {associations} a JOIN {content_items} i ON i.id = a.id AND i.content_type = 'com_content.article'),
anchor AS (SELECT context, key, max(id) AS source_id FROM m WHERE language = 'en-GB' GROUP BY ALL),
target AS (SELECT context, key, language, arg_max(state, id) AS st FROM m WHERE language NOT IN ('en-GB', '', '*') AND state <> -2 GROUP BY ALL),
plan AS (SELECT source_id, language, CASE st WHEN 1 THEN 'published' ELSE 'review' END AS state FROM anchor JOIN target USING (context, key))"""
_VERSIONS = """v AS (SELECT regexp_extract(item_id, '^(.*)\\.[^.]*$', 1) AS alias, CAST(string_split(item_id, '.')[-1] AS BIGINT) AS item_id, max(version_id) AS version_id FROM {history} GROUP BY ALL),
newest AS (SELECT q.id AS queue_id, v.version_id FROM v JOIN {queue} q ON q.content_id = v.item_id AND q.content_type = 'com_content.article' WHERE alias = 'com_content.article' AND item_id > 0)"""
_WORDS = r"""t AS (SELECT i.id AS item_id, concat_ws(' ', i.title, i.introtext) AS text, l.lang_code AS target_language FROM {content_items} i JOIN {languages} l ON l.lang_code IN ('fr-FR', 'de-DE', 'es-ES')
  WHERE i.content_type = 'com_content.article' AND """ + _SOURCE + ")"


def _match(rules: str) -> str:
    """CTEs for the rules that match the texts t; needles are single words in these tables, so whole words are runs."""
    return rf"""u AS (SELECT DISTINCT item_id, text FROM t),
runs AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM u),
toks AS (SELECT DISTINCT item_id, lower(w) AS w FROM (SELECT item_id, unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}''-]+')) AS w FROM u) WHERE length(w) >= 3),
rr AS ({rules}),
needle AS (SELECT id, target_language, lower(source_term) AS w FROM rr WHERE rule_type <> 'style' AND source_term <> '' UNION
  SELECT id, target_language, lower(k) FROM (SELECT id, target_language, unnest(string_split_regex(search_keywords, '[\s,;]+')) AS k FROM rr WHERE rule_type <> 'style') WHERE length(k) >= 3),
hit AS (SELECT t.item_id, t.target_language, n.id AS rule_id FROM t JOIN runs USING (item_id) JOIN needle n ON n.w = runs.w AND n.target_language = t.target_language UNION
  SELECT t.item_id, t.target_language, rr.id FROM t JOIN toks USING (item_id) JOIN {{standard_forms}} f ON f.word = toks.w
  JOIN rr ON rr.source_term_standard = f.standard_form AND rr.source_term_standard <> '' AND rr.target_language = t.target_language AND rr.rule_type <> 'style')"""


def _select(rules: str, order: str, most: int, style: int) -> str:
    return _match(rules) + rf""",
pool AS (SELECT t.item_id, t.target_language, s.* EXCLUDE (target_language, n) FROM (SELECT DISTINCT item_id, target_language FROM t) t
  JOIN (SELECT *, row_number() OVER (PARTITION BY target_language ORDER BY {order}) AS n FROM rr WHERE rule_type = 'style') s ON s.target_language = t.target_language AND s.n <= {style}
  UNION ALL SELECT h.item_id, h.target_language, rr.* EXCLUDE (target_language) FROM hit h JOIN rr ON rr.id = h.rule_id),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, target_language ORDER BY {order}) AS place FROM pool) WHERE place <= {most})"""


_RETRIEVED = "WITH " + _WORDS + ",\n" + _select("SELECT * FROM {rules} WHERE state = 1", "confidence_percent DESC, id DESC", 30, 10)
_ERROR = """CASE WHEN trim(rule_name) = '' THEN 'name' WHEN rule_type NOT IN ('terminology', 'style', 'preservation') THEN 'type'
  WHEN rule_type = 'terminology' AND (coalesce(s, '') = '' OR coalesce(g, '') = '') THEN 'terms' WHEN rule_type = 'preservation' AND coalesce(s, '') = '' THEN 'term' WHEN rule_type = 'style' AND trim(rule_text) = '' THEN 'text' END"""
_CHECKED = f"""c AS (SELECT *, nullif(trim(source_term), '') AS s, nullif(trim(target_term), '') AS g FROM {{candidates}}),
k AS (SELECT id, seq, feedback_id, rule_name, rule_type, rule_text, {_ERROR} AS rule_error, CASE WHEN rule_type = 'style' THEN '' ELSE s END AS source_term, CASE WHEN rule_type IN ('style', 'preservation') THEN '' ELSE g END AS target_term,
  CASE WHEN rule_type = 'style' THEN '' ELSE search_keywords END AS search_keywords, greatest(0, least(100, confidence_percent)) AS confidence_percent FROM c)"""
_CELL = "st.translation_state"

_SQL: dict[str, str] = {
    "work_queue": f"""WITH l AS (SELECT lang_code, CAST(row_number() OVER (ORDER BY ordering, lang_code) - 1 AS INT) AS lang_rank FROM {{languages}} WHERE published = 1 AND lang_code NOT IN ('*', 'en-GB'))
SELECT i.content_type, i.id, l.lang_code AS target_language, {_RANK} AS type_rank, lang_rank FROM {{content_items}} i CROSS JOIN l LEFT JOIN {{queue}} q ON q.content_type = i.content_type AND q.content_id = i.id
LEFT JOIN {{queue_states}} s ON s.queue_id = q.id AND s.target_language = l.lang_code WHERE {_SOURCE} AND coalesce(q.do_not_translate, 0) = 0 AND (s.id IS NULL OR s.translation_state = 'pending')
ORDER BY type_rank, lang_rank, i.id LIMIT 50""",
    "translate_guards": f"""SELECT i.content_type, i.id, CASE WHEN NOT ({_SCOPE}) THEN 'scope' WHEN i.language = '*' THEN 'all-languages' WHEN i.language = 'fr-FR' THEN 'same-language' WHEN coalesce(q.do_not_translate, 0) <> 0 THEN 'opted-out' END AS reject_reason
FROM {{content_items}} i LEFT JOIN {{queue}} q ON q.content_type = i.content_type AND q.content_id = i.id""",
    "target_languages": "SELECT lang_code, title, ordering, 'English' AS source_title FROM {languages} WHERE published = 1 AND lang_code NOT IN ('*', 'en-GB') AND lang_code IN ('fr-FR', 'es-ES', 'it-IT')",
    "queue_grid": f"""WITH s AS (SELECT queue_id, target_language, arg_max(translation_state, id) AS st FROM {{queue_states}} GROUP BY ALL)
SELECT i.content_type, i.id, i.title, i.state, coalesce(q.do_not_translate, 0) AS do_not_translate, f.st AS fr_FR, d.st AS de_DE, e.st AS es_ES FROM {{content_items}} i LEFT JOIN {{queue}} q ON q.content_type = i.content_type AND q.content_id = i.id
LEFT JOIN s f ON f.queue_id = q.id AND f.target_language = 'fr-FR' LEFT JOIN s d ON d.queue_id = q.id AND d.target_language = 'de-DE' LEFT JOIN s e ON e.queue_id = q.id AND e.target_language = 'es-ES'
WHERE {_SOURCE} AND coalesce(q.do_not_translate, 0) = 0""",
    "queue_opted_out": f"""SELECT i.content_type, i.id, i.title, q.do_not_translate, coalesce(i.checked_out, 0) IN (0, 1) AS may_edit FROM {{content_items}} i JOIN {{queue}} q ON q.content_type = i.content_type AND q.content_id = i.id
WHERE {_SOURCE} AND q.do_not_translate = 1""",
    "queue_status_filter": f"""SELECT i.content_type, i.id, i.title FROM {{content_items}} i WHERE {_SOURCE} AND (
NOT EXISTS (SELECT 1 FROM {{queue}} q JOIN {{queue_states}} s ON s.queue_id = q.id WHERE q.content_type = i.content_type AND q.content_id = i.id) OR
EXISTS (SELECT 1 FROM {{queue}} q JOIN {{queue_states}} s ON s.queue_id = q.id WHERE q.content_type = i.content_type AND q.content_id = i.id AND s.translation_state IN ('review')))""",
    "queue_search": f"SELECT i.content_type, i.id, i.title FROM {{content_items}} i WHERE {_SOURCE} AND lower(i.title) LIKE '%th%an%' ORDER BY i.id DESC, i.id LIMIT 25",
    "queue_visibility": f"""WITH {_GROUPS},
live AS (SELECT g.id, g.language, arg_max(g.state, g.member_id) = 1 AS live FROM g SEMI JOIN {{queue}} q ON q.content_id = g.id GROUP BY ALL),
st AS (SELECT q.content_id AS id, s.target_language AS language, arg_max(s.translation_state, s.id) AS translation_state FROM {{queue}} q JOIN {{queue_states}} s ON s.queue_id = q.id GROUP BY ALL)
SELECT id, language, {_CELL}, live.live, coalesce({_CELL} IN ('review', 'approved'), false) AS editable, {_CELL} IS NULL OR {_CELL} = 'pending' AS translatable, coalesce(live.live, false) <> coalesce({_CELL} = 'published', false) AS live_marker
FROM st FULL JOIN live USING (id, language)""",
    "rules_list": """SELECT r.id, r.rule_name, r.rule_type, r.target_language, l.title AS language_title, u.name AS editor, r.state, r.ordering FROM {rules} r LEFT JOIN {languages} l ON l.lang_code = r.target_language LEFT JOIN {users} u ON u.id = r.checked_out
WHERE r.state IN (0, 1) AND (lower(rule_name) LIKE '%a%' OR lower(rule_text) LIKE '%a%' OR lower(source_term) LIKE '%a%' OR lower(target_term) LIKE '%a%')""",
    "association_group": f"WITH {_GROUPS} SELECT * FROM g WHERE member_id <> id",
    "source_of_translation": "SELECT a.id, min(q.id) AS queue_id FROM {associations} a JOIN {associations} b ON a.context = b.context AND a.key = b.key AND a.id <> b.id JOIN {queue} q ON q.content_id = b.id GROUP BY a.id",
    "related_remap": f"""WITH {_GROUPS}, {_TO}, x AS (SELECT id, CASE WHEN id % 6 = 0 THEN 0 ELSE id + 1 END AS ref FROM {{content_items}} WHERE content_type = 'com_content.article')
SELECT x.id, CASE WHEN ref = 0 THEN 0 ELSE coalesce(r.member_id, ref) END AS related FROM x LEFT JOIN r ON r.id = x.ref""",
    "tag_remap": f"WITH {_GROUPS}, {_TO} SELECT DISTINCT content_item_id, coalesce(r.member_id, tag_id) AS tag_id FROM {{tag_map}} LEFT JOIN r ON r.id = tag_id",
    "backfill_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "source_versions": f"WITH {_VERSIONS} SELECT * FROM v WHERE alias IN ('com_content.article', 'com_content.category', 'com_tags.tag') AND item_id > 0",
    "field_assignments": "SELECT field_id, CAST(4 AS BIGINT) AS category_id FROM {fields_categories} WHERE category_id = 3 AND field_id NOT IN (SELECT field_id FROM {fields_categories} WHERE category_id = 4)",
    "invalidate_translations": f"""WITH {_VERSIONS} SELECT s.id, s.queue_id, s.target_language, CASE WHEN s.translation_state IN ('review', 'approved', 'published') AND s.source_version_id < newest.version_id THEN 'pending' ELSE s.translation_state END AS translation_state, s.source_version_id
FROM {{queue_states}} s LEFT JOIN newest USING (queue_id)""",
    "upsert_review_state": """WITH c AS (SELECT queue_id, CASE WHEN queue_id % 2 = 0 THEN target_language ELSE 'it-IT' END AS target_language, max(source_version_id + 1) AS v FROM {queue_states} WHERE queue_id % 5 = 0 GROUP BY ALL)
SELECT id, queue_id, target_language, CASE WHEN v IS NOT NULL THEN 'review' ELSE translation_state END AS translation_state, coalesce(v, source_version_id) AS source_version_id FROM {queue_states} LEFT JOIN c USING (queue_id, target_language)
UNION ALL SELECT (SELECT max(id) FROM {queue_states}) + row_number() OVER (ORDER BY target_language, queue_id), queue_id, target_language, 'review', v FROM c
WHERE NOT EXISTS (SELECT 1 FROM {queue_states} s WHERE s.queue_id = c.queue_id AND s.target_language = c.target_language)""",
    "ensure_queue": """WITH w AS (SELECT content_type, id AS content_id FROM {content_items} i WHERE id % 7 = 0 AND NOT EXISTS (SELECT 1 FROM {queue} q WHERE q.content_type = i.content_type AND q.content_id = i.id))
SELECT id, content_type, content_id, do_not_translate FROM {queue} UNION ALL SELECT (SELECT max(id) FROM {queue}) + row_number() OVER (ORDER BY content_type, content_id), content_type, content_id, 0 FROM w""",
    "seed_states": f"""WITH {_PLAN} SELECT id, queue_id, target_language, translation_state, source_version_id FROM {{queue_states}} UNION ALL
SELECT (SELECT max(id) FROM {{queue_states}}) + row_number() OVER (ORDER BY language, source_id), source_id, language, state, CAST(0 AS BIGINT) FROM plan WHERE NOT EXISTS (SELECT 1 FROM {{queue_states}} s WHERE s.queue_id = source_id AND s.target_language = language)""",
    "optout_flags": """WITH f AS (SELECT content_type, id AS content_id, CAST(id % 2 AS INT) AS flag FROM {content_items} WHERE content_type = 'com_content.article' AND id % 4 IN (0, 1)),
u AS (SELECT q.id, content_type, content_id, coalesce(flag, do_not_translate) AS d FROM {queue} q LEFT JOIN f USING (content_type, content_id)),
n AS (SELECT (SELECT max(id) FROM {queue}) + row_number() OVER (ORDER BY content_type, content_id) AS id, content_type, content_id, 1 AS d FROM f WHERE flag = 1 AND NOT EXISTS (SELECT 1 FROM {queue} q WHERE q.content_type = f.content_type AND q.content_id = f.content_id))
SELECT content_type, content_id, CASE WHEN id % 9 = 0 THEN 0 ELSE d END AS do_not_translate FROM (SELECT * FROM u UNION ALL SELECT * FROM n)""",
    "delete_cascade": f"""WITH {_GROUPS}, x AS (SELECT *, count(*) OVER w AS n, max(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END) OVER w AS hit FROM {{associations}} WINDOW w AS (PARTITION BY context, key)),
ql AS (SELECT * FROM {{queue}} WHERE content_id % 10 <> 0), below AS (SELECT DISTINCT member_id FROM g WHERE id % 10 = 0 AND member_id <> id)
SELECT 'association' AS kind, id, key AS detail FROM x WHERE id % 10 <> 0 AND NOT (hit = 1 AND n <= 2) UNION ALL SELECT 'queue', id, content_type FROM ql
UNION ALL SELECT 'state', queue_id, target_language FROM {{queue_states}} s SEMI JOIN ql ON ql.id = s.queue_id WHERE NOT (target_language = 'es-ES' AND queue_id % 3 = 0)
UNION ALL SELECT 'item', id, CAST(CASE WHEN id IN (SELECT member_id FROM below) THEN -2 ELSE state END AS VARCHAR) FROM {{content_items}} WHERE content_type = 'com_content.article'""",
    "decide_states": "SELECT id, queue_id, target_language, CASE WHEN translation_state = 'review' AND queue_id % 2 = 1 THEN 'approved' ELSE translation_state END AS translation_state, source_version_id FROM {queue_states}",
    "regroup_associations": """WITH p AS (SELECT id, id // 12 AS g, concat('l', id % 12) AS l FROM {content_items} WHERE content_type = 'com_content.article' AND id % 12 < 3),
k AS (SELECT g, md5('{' || string_agg('"' || l || '":' || id, ',' ORDER BY l, id) || '}') AS key FROM p GROUP BY g HAVING count(DISTINCT (l, id)) >= 2), n AS (SELECT p.id, 'com_content.item' AS context, k.key FROM p JOIN k USING (g))
SELECT id, context, key FROM {associations} a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = a.id AND n.context = a.context) UNION ALL SELECT * FROM n""",
    "token_lemmas": r"""WITH w AS (SELECT DISTINCT id, lower(x) AS word FROM (SELECT id, unnest(string_split_regex(introtext, '[^\p{L}\p{N}''-]+')) AS x FROM {content_items} WHERE content_type = 'com_content.article' AND language = 'en-GB') WHERE length(x) >= 3)
SELECT w.word, count(*) AS items, any_value(standard_form) AS standard_form FROM w LEFT JOIN {standard_forms} f ON f.word = w.word GROUP BY w.word""",
    "word_batches": r"""WITH w AS (SELECT lower(x) AS word, min(doc_id) AS at_ FROM (SELECT doc_id, unnest(string_split_regex(text, '[^\p{L}\p{N}''-]+')) AS x FROM documents) WHERE length(x) >= 3 GROUP BY 1),
n AS (SELECT word, row_number() OVER (ORDER BY at_, word) - 1 AS n FROM w WHERE word NOT IN (SELECT word FROM {standard_forms})) SELECT word, CAST(n // 200 AS BIGINT) AS batch_id FROM n WHERE n < 1000""",
    "rule_matches": "WITH " + _WORDS + ",\n" + _match("SELECT * FROM {rules} WHERE state = 1") + " SELECT item_id, target_language, rule_id FROM hit",
    "rule_retrieval": _RETRIEVED + " SELECT item_id, target_language, id, rule_type, CAST(place AS INT) AS place, coalesce(source_term, '') AS source_term, coalesce(target_term, '') AS target_term FROM sel",
    "rule_guidance": _RETRIEVED + """, lines AS (SELECT item_id, target_language, rule_type, place, '- ' || CASE WHEN trim(rule_text) <> '' THEN rule_text WHEN coalesce(target_term, '') <> '' THEN source_term || ' = ' || target_term ELSE source_term END AS line FROM sel),
parts AS (SELECT item_id, target_language, CASE rule_type WHEN 'terminology' THEN 0 WHEN 'style' THEN 1 ELSE 2 END AS o, CASE rule_type WHEN 'terminology' THEN 'Terminology:' WHEN 'style' THEN 'Style:' ELSE 'Keep unchanged:' END || chr(10) || string_agg(line, chr(10) ORDER BY place) AS part
  FROM lines GROUP BY item_id, target_language, rule_type) SELECT item_id, target_language, string_agg(part, chr(10) || chr(10) ORDER BY o) AS guidance FROM parts GROUP BY ALL""",
    "translatable_strings": """WITH i AS (SELECT * FROM {content_items} WHERE content_type = 'com_content.article'), x AS (
SELECT id, unnest(['title', 'introtext', 'fulltext', 'metadesc', 'metakey', 'note']) AS key, unnest([title, introtext, fulltext, metadesc, metakey, note]) AS value FROM i UNION ALL
SELECT id, 'images.' || k, json_extract_string(images, '$.' || k) FROM i, (VALUES ('image_intro_alt'), ('image_intro_caption'), ('image_fulltext_alt'), ('image_fulltext_caption')) t(k) WHERE images <> '' UNION ALL
SELECT item_id, 'com_fields:' || name, value FROM {item_fields} WHERE type IN ('text', 'textarea')) SELECT id, key, value FROM x WHERE trim(value) <> ''""",
    "flat_fields": """WITH i AS (SELECT * FROM {content_items} WHERE content_type = 'com_content.article'), x AS (
SELECT id, unnest(['title', 'introtext', 'fulltext', 'metadesc', 'metakey', 'note']) AS key, unnest([title, introtext, fulltext, metadesc, metakey, note]) AS value FROM i UNION ALL
SELECT id, k, CASE WHEN images <> '' THEN json_extract_string(images, '$.' || k) END FROM i, (VALUES ('image_intro_alt'), ('image_intro_caption'), ('image_fulltext_alt'), ('image_fulltext_caption')) t(k)) SELECT id, key, coalesce(value, '') AS value FROM x""",
    "feedback_pairs": """SELECT s.queue_id, s.target_language, s.field, CASE s.field WHEN 'title' THEN i.title WHEN 'introtext' THEN i.introtext ELSE '' END AS source_text, s.draft AS machine_draft, s.draft || ' edited' AS human_correction
FROM {snapshots} s JOIN {content_items} i ON i.id = s.queue_id AND i.content_type = 'com_content.article' WHERE s.translation_state = 'review' AND s.queue_id % 4 = 0""",
    "pending_feedback": "SELECT id, target_language, created_day FROM {feedback} WHERE status = 'pending' ORDER BY created_day, id LIMIT 20",
    "distil_context": "WITH t AS (SELECT CAST(0 AS BIGINT) AS item_id, target_language, string_agg(source_text, ' ' ORDER BY id) AS text FROM (SELECT * FROM {feedback} WHERE status = 'pending') GROUP BY target_language),\nu0 AS (SELECT 1),\n"
    + _select("SELECT * FROM {rules} WHERE state IN (0, 1)", "state ASC, confidence_percent DESC, id DESC", 50, 15).replace("u AS (SELECT DISTINCT item_id, text FROM t)", "u AS (SELECT target_language AS item_id, text FROM t)")
    .replace("JOIN runs USING (item_id)", "JOIN runs ON runs.item_id = t.target_language").replace("JOIN toks USING (item_id)", "JOIN toks ON toks.item_id = t.target_language")
    + " SELECT target_language, CAST(place AS INT) AS place, id, rule_type, rule_name, rule_text, source_term, target_term FROM sel",
    "mark_processed": "WITH b AS (SELECT id FROM {feedback} WHERE status = 'pending' ORDER BY created_day, id LIMIT 20) SELECT id, CASE WHEN id IN (SELECT id FROM b) THEN 'processed' ELSE status END AS status FROM {feedback}",
    "rule_validation": f"WITH {_CHECKED} SELECT seq, rule_error, rule_type, source_term, target_term, search_keywords, confidence_percent FROM k",
    "rule_upsert": f"""WITH {_CHECKED}, ok AS (SELECT * FROM k WHERE rule_error IS NULL), ref AS (SELECT ok.* FROM ok WHERE id > 0 AND id IN (SELECT id FROM {{rules}})),
old AS (SELECT r.*, [r.id, r.id + 1] AS ids FROM {{rules}} r),
std AS (SELECT word, min(standard_form) AS form FROM {{standard_forms}} GROUP BY word),
upd AS (SELECT old.id, coalesce(ref.rule_name, old.rule_name) AS rule_name, coalesce(ref.rule_type, old.rule_type) AS rule_type, CASE WHEN ref.id IS NULL THEN old.target_language ELSE 'fr-FR' END AS target_language,
  coalesce(ref.rule_text, old.rule_text) AS rule_text, CASE WHEN ref.id IS NULL THEN old.source_term_standard ELSE std.form END AS source_term_standard, CASE WHEN ref.id IS NULL THEN old.search_keywords ELSE ref.search_keywords END AS search_keywords, old.ordering, old.checked_out,
  CASE WHEN ref.id IS NULL THEN old.source_term ELSE ref.source_term END AS source_term, CASE WHEN ref.id IS NULL THEN old.target_term ELSE ref.target_term END AS target_term, greatest(old.confidence_percent, coalesce(ref.confidence_percent, old.confidence_percent)) AS confidence_percent,
  old.state, old.source_origin, unnest(list_distinct(list_concat(old.ids, CASE WHEN ref.id IS NULL THEN [] ELSE [ref.feedback_id, ref.id] END))) AS feedback_id FROM old LEFT JOIN ref ON ref.id = old.id LEFT JOIN std ON std.word = lower(ref.source_term)),
new AS (SELECT (SELECT max(id) FROM {{rules}}) + row_number() OVER (ORDER BY seq) AS id, rule_name, rule_type, 'fr-FR' AS target_language, rule_text, std.form AS source_term_standard, search_keywords, CAST((SELECT max(ordering) FROM {{rules}}) + row_number() OVER (ORDER BY seq) AS INT) AS ordering, CAST(NULL AS BIGINT) AS checked_out,
  source_term, target_term, confidence_percent, 0 AS state, 'distilled' AS source_origin, list_distinct([feedback_id, id]) AS ids FROM ok LEFT JOIN std ON std.word = lower(ok.source_term) WHERE NOT (id > 0 AND id IN (SELECT id FROM {{rules}})))
SELECT * FROM upd UNION ALL SELECT * EXCLUDE (ids), unnest(ids) FROM new""",
    "new_rules": "SELECT id, CAST((SELECT max(ordering) FROM {rules}) + row_number() OVER (ORDER BY id) AS INT) AS ordering, CASE WHEN confidence_percent = 0 THEN 100 ELSE confidence_percent END AS confidence_percent, rule_text FROM {rules} WHERE id % 3 = 0",
    "failure_runs": """WITH e AS (SELECT user_id AS run_id, event_id AS seq, event_id % 3 = 0 AS ok, lag(event_id % 3 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
s AS (SELECT run_id, min(seq) AS stop FROM e WHERE NOT ok AND before = false GROUP BY run_id) SELECT e.run_id, count(*) AS steps, max(seq) AS last_seq FROM e LEFT JOIN s USING (run_id) WHERE stop IS NULL OR seq <= stop GROUP BY e.run_id""",
}

_SQL |= {
    "item_lookup": "SELECT id, title, language, state, alias FROM {content_items} WHERE content_type = 'com_content.article' AND id = 7",
    "queue_cells": """SELECT i.id, q.id AS queue_id, s.translation_state, s.source_version_id FROM {content_items} i LEFT JOIN {queue} q ON q.content_type = i.content_type AND q.content_id = i.id
LEFT JOIN {queue_states} s ON s.queue_id = q.id AND s.target_language = 'fr-FR' WHERE i.content_type = 'com_content.article'""",
    "item_tags": "SELECT content_item_id AS id, string_agg(tag_id, ',' ORDER BY tag_id) AS tags FROM {tag_map} GROUP BY content_item_id",
    "custom_fields": "SELECT item_id, 'com_fields:' || name AS key, value, trim(value) <> '' AS translated FROM {item_fields} WHERE type IN ('text', 'textarea')",
    "standard_terms": "SELECT r.id, r.source_term, f.standard_form AS source_term_standard FROM {rules} r LEFT JOIN {standard_forms} f ON f.word = lower(r.source_term) AND r.source_term <> ''",
    "language_menus": "SELECT lower(n_name) AS menutype, n_name AS title, 0 AS client_id FROM nation UNION ALL SELECT lower(n_name) || '-fr-fr', n_name || ' (fr-FR)', 0 FROM nation WHERE n_nationkey % 2 = 0",
    "changed_titles": "SELECT * FROM (SELECT user_id AS item_id, event_id AS seq, event_type AS title, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before <> title",
}
_SQL["plain_text"] = r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<[A-Za-z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>', '', 'g') AS x FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM s"""
_WORDWISE = "list_reduce(list_transform(string_split({0}, ' '), lambda w: CASE w WHEN 'the' THEN 'le' WHEN 'and' THEN 'et' WHEN 'of' THEN 'de' ELSE w END), lambda a, b: a || ' ' || b)"
_SQL["dictionary_translate"] = (
    f"""WITH s AS (SELECT id, alias, images, {_WORDWISE.format("title")} AS title, {_WORDWISE.format("introtext")} AS intro, CASE WHEN trim(fulltext) <> '' THEN {_WORDWISE.format("fulltext")} ELSE '' END AS full_
  FROM {{content_items}} i WHERE content_type = 'com_content.article' AND {_SOURCE}),"""
    + r""" a AS (SELECT *, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM s)
SELECT id, title, CASE WHEN slug = alias THEN slug || '-fr-fr' ELSE '' END AS alias, intro || CASE WHEN full_ <> '' THEN '<hr id="system-readmore">' || full_ ELSE '' END AS body, images, CAST(NULL AS VARCHAR) AS error FROM a"""
)
_SQL |= {
    "queue_search_escaped": rf"""WITH s AS (SELECT i.content_type, i.id, i.id % 4 AS n FROM {{content_items}} i WHERE {_SOURCE})
SELECT content_type, id, CAST(n AS INT) AS search FROM s WHERE n < 3""",
    "item_search_by_id": "SELECT content_type, id, 12 AS search FROM {content_items} WHERE id = 12 UNION ALL SELECT content_type, id, 0 FROM {content_items} WHERE id = 0",
    "rules_page": """SELECT r.id, r.rule_name, r.confidence_percent, l.title AS language_title FROM {rules} r LEFT JOIN {languages} l ON l.lang_code = r.target_language
WHERE r.state = 1 AND r.rule_type = 'terminology' AND r.target_language = 'es-ES' AND r.source_origin = 'distilled' ORDER BY r.confidence_percent DESC, r.id LIMIT 25""",
    "rules_by_state": "SELECT id, state, '-2' AS filter FROM {rules} WHERE state = -2 UNION ALL SELECT id, state, '*' FROM {rules}",
    "language_picker": "SELECT lang_code AS value, title AS label, ordering FROM {languages} WHERE lang_code NOT IN ('', '*', 'en-GB')",
    "submitted_values": "SELECT id, CASE WHEN id % 2 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN id % 2 = 0 THEN note ELSE 'noted' END AS note FROM {content_items} WHERE content_type = 'com_content.article'",
    "cell_snapshots": """SELECT s.queue_id, s.target_language, s.translation_state, p.field IS NULL AS empty, p.field, CASE WHEN p.field IS NOT NULL THEN coalesce(p.draft, '') END AS draft
FROM {queue_states} s LEFT JOIN {snapshots} p ON p.queue_id = s.queue_id AND p.target_language = s.target_language""",
    "delete_events": f"""WITH {_GROUPS}, gone AS (SELECT id, language FROM {{content_items}} WHERE content_type = 'com_content.article' AND id % 10 = 0), src AS (SELECT id FROM gone WHERE id IN (SELECT content_id FROM {{queue}})),
below AS (SELECT DISTINCT member_id FROM g WHERE id IN (SELECT id FROM src) AND member_id <> id),
cell AS (SELECT q.queue_id, gone.language FROM gone JOIN (SELECT a.id, min(q.id) AS queue_id FROM {{associations}} a JOIN {{associations}} b ON a.context = b.context AND a.key = b.key AND a.id <> b.id JOIN {{queue}} q ON q.content_id = b.id GROUP BY a.id) q ON q.id = gone.id
  WHERE gone.id NOT IN (SELECT id FROM src)),
ql AS (SELECT * FROM {{queue}} WHERE content_id NOT IN (SELECT id FROM src))
SELECT 'item' AS kind, id, language AS detail FROM {{content_items}} WHERE content_type = 'com_content.article' AND id % 10 <> 0 AND id NOT IN (SELECT member_id FROM below)
UNION ALL SELECT 'queue', id, content_type FROM ql
UNION ALL SELECT 'state', queue_id, target_language FROM {{queue_states}} s WHERE EXISTS (SELECT 1 FROM ql WHERE ql.id = s.queue_id) AND NOT EXISTS (SELECT 1 FROM cell c WHERE c.queue_id = s.queue_id AND c.language = s.target_language)""",
    "optout_events": """WITH f AS (SELECT content_type, id AS content_id, CAST(id % 2 AS INT) AS flag FROM {content_items} WHERE content_type = 'com_content.article' AND id % 4 IN (0, 1) AND language = 'en-GB')
SELECT q.id, content_type, content_id, coalesce(flag, do_not_translate) AS do_not_translate FROM {queue} q LEFT JOIN f USING (content_type, content_id)
UNION ALL SELECT (SELECT max(id) FROM {queue}) + row_number() OVER (ORDER BY content_type, content_id), content_type, content_id, 1 FROM f WHERE flag = 1 AND NOT EXISTS (SELECT 1 FROM {queue} q WHERE q.content_type = f.content_type AND q.content_id = f.content_id)""",
}
_WORDED = lambda c: f"CASE WHEN trim({c}) <> '' THEN {_WORDWISE.format(c)} ELSE {c} END"
_SQL["draft_items"] = (
    f"""WITH {_GROUPS}, r AS (SELECT id, max(member_id) AS member_id, arg_max(state, member_id) AS st FROM g WHERE member_id <> id AND language = 'fr-FR' GROUP BY id),
n AS (SELECT id, string_agg(language || ':' || member_id, chr(10) ORDER BY language) AS members FROM (SELECT id, language, max(member_id) AS member_id FROM g WHERE member_id <> id AND language <> 'en-GB' GROUP BY ALL
  UNION ALL SELECT id, 'en-GB', id FROM {{content_items}} WHERE content_type = 'com_content.article') GROUP BY id),
tags AS (SELECT content_item_id AS id, string_agg(tag_id, ',' ORDER BY tag_id) AS tags FROM {{tag_map}} GROUP BY ALL),
custom AS (SELECT item_id AS id, string_agg(name || '=' || CASE WHEN type IN ('text', 'textarea', 'editor', 'note') THEN {_WORDED("value")} ELSE value END, chr(10) ORDER BY name) AS v FROM {{item_fields}} GROUP BY item_id),
s AS (SELECT i.*, i.content_type = 'com_content.article' AS art, {_WORDED("title")} AS t2, {_WORDED("introtext")} AS i2, {_WORDED("fulltext")} AS f2, {_WORDED("metadesc")} AS m2, {_WORDED("note")} AS n2, {_WORDED("description")} AS d2
  FROM {{content_items}} i WHERE {_SOURCE}),"""
    + r""" a AS (SELECT *, trim(regexp_replace(lower(t2), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM s)
SELECT a.content_type, a.id AS source_id, CASE WHEN art THEN coalesce(r.member_id, 0) ELSE 0 END AS id, 'fr-FR' AS language, t2 AS title, CASE WHEN slug = alias THEN slug || '-fr-fr' ELSE '' END AS alias,
  CASE WHEN art THEN coalesce(i2, '') || CASE WHEN trim(coalesce(f2, '')) <> '' THEN '<hr id="system-readmore">' || f2 ELSE '' END END AS articletext, CASE WHEN a.content_type <> 'com_menus.item' THEN m2 END AS metadesc,
  CASE WHEN a.content_type <> 'com_menus.item' THEN n2 END AS note, CASE WHEN a.content_type IN ('com_categories.category', 'com_tags.tag') THEN d2 END AS description,
  CASE WHEN art OR a.content_type = 'com_tags.tag' THEN images END AS images, CASE WHEN art THEN catid END AS catid,
  CASE WHEN art THEN coalesce(tags.tags, '') WHEN a.content_type = 'com_categories.category' THEN '' END AS tags, CASE WHEN art THEN coalesce(r.st, 0) ELSE 0 END AS state, CASE WHEN a.content_type = 'com_menus.item' THEN 0 END AS home,
  CASE WHEN a.content_type = 'com_menus.item' THEN 1 END AS parent_id, CASE WHEN a.content_type = 'com_menus.item' THEN 'main-fr-fr' END AS menutype, CASE WHEN art THEN n.members ELSE 'en-GB:' || a.id END AS members, CASE WHEN art THEN coalesce(custom.v, '') END AS custom
FROM a LEFT JOIN r ON r.id = a.id LEFT JOIN n ON n.id = a.id LEFT JOIN tags ON tags.id = a.id LEFT JOIN custom ON custom.id = a.id"""
)
_FOLDED = "replace(strip_accents(lower({0})), 'ß', 'ss')"
_EDITED = r"regexp_replace(regexp_replace(text, '\bthe\b', 'that', 'g'), '^\S+ ', '')"
_MARKED = "CASE id % 3 WHEN 0 THEN translate(title, 'eao', 'ÉÄÔ') WHEN 1 THEN translate(title, 'eao', 'èáö') ELSE upper(title) END"
_SQL |= {
    "correction_rebuilt": f"SELECT doc_id, sha256(regexp_replace(coalesce({_EDITED}, ''), '^\\s+', '')) AS rebuilt_sha256 FROM documents",
    "packed_images": """SELECT id, id::VARCHAR AS n, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, '{"a":[1,2,{"b":"x"}]}' AS nested, 'new "' || id || '"' AS image_intro_alt, '1' AS text,
'flag,image_intro_alt,n,nested,none,text' AS keys, true AS text_is_text FROM {content_items} WHERE content_type = 'com_content.article'""",
    "queue_search_accents": f"""WITH s AS (SELECT i.content_type, i.id, {_FOLDED.format(_MARKED.replace("id %", "i.id %"))} AS title FROM {{content_items}} i WHERE {_SOURCE})
SELECT content_type, id, search FROM s JOIN (VALUES ('the', '%the%'), ('ÉA', '%ea%'), ('rò ç', '%ro%c%')) AS v(search, p) ON title LIKE p""",
    "standard_terms": f"""WITH f AS (SELECT {_FOLDED.format("word")} AS w, min(standard_form) AS standard_form FROM {{standard_forms}} GROUP BY 1)
SELECT r.id, r.source_term, f.standard_form AS source_term_standard FROM {{rules}} r LEFT JOIN f ON f.w = {_FOLDED.format("r.source_term")} AND r.source_term <> ''""",
    "standard_terms_accents": f"""WITH f AS (SELECT {_FOLDED.format("word")} AS w, min(standard_form) AS standard_form FROM {{standard_forms}} GROUP BY 1), r AS (SELECT id, translate(source_term, 'eaou', 'ÉäÔù') AS source_term FROM {{rules}})
SELECT r.id, r.source_term, f.standard_form AS source_term_standard FROM r LEFT JOIN f ON f.w = {_FOLDED.format("r.source_term")} AND r.source_term <> ''""",
    "translation_run": f"""WITH w AS ({{work}}),
s AS (SELECT w.*, i.title, contains(' ' || concat_ws(' ', i.title, i.introtext, i.fulltext, i.metadesc, i.note, i.description) || ' ', ' lavender ') AS bad, row_number() OVER (ORDER BY w.type_rank, w.lang_rank, w.id) AS seq
  FROM w JOIN {{content_items}} i ON i.content_type = w.content_type AND i.id = w.id),
l AS (SELECT *, bad AND coalesce(lag(bad) OVER (ORDER BY seq), false) AS two FROM s),
e AS (SELECT coalesce(min(seq) FILTER (WHERE two), 1000000) AS stop, count(*) AS n, count(*) FILTER (WHERE bad) AS bads FROM l)
SELECT seq, content_type, id, target_language, NOT bad AS ok, CASE WHEN NOT bad THEN array_to_string(list_transform(string_split(title, ' '), lambda x: CASE x WHEN 'almond' THEN 'amande' WHEN 'red' THEN 'rouge' ELSE x END), ' ') END AS title,
  CASE WHEN NOT bad THEN 'review' END AS translation_state, CASE WHEN NOT bad THEN 0::BIGINT END AS source_version_id, CASE WHEN stop < 1000000 THEN 'error' WHEN n - bads = 50 THEN 'resume' ELSE 'done' END AS outcome FROM l, e WHERE seq <= stop""".replace("{work}", _SQL["work_queue"]),
}
for _name in ("queue_search", "rules_list"):  # strings are compared without regard to case and accents
    _SQL[_name] = re.sub(r"lower\(([a-z_.]+)\) LIKE", lambda m: f"{_FOLDED.format(m[1])} LIKE", _SQL[_name])
_SQL["change_feed_invalidate"] = _SQL["invalidate_translations"]
ORACLES: dict[str, str] = {name: with_tables(sql) for name, sql in _SQL.items()}
