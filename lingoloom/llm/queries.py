"""The queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fingerprint, hard_negatives, jaccard, langid, pii, quality, simhash, suffix_dedup, urlfilter, vector_codes, warc

#: Fixed values of the URL query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    documents = table(spark, sf_dir, "documents")
    return bpe.encode(documents, tokenizers.path(RANKS), tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled of good quality."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    documents = table(spark, sf_dir, "documents").withColumn("held_out", fold == 1)
    return langid.predict(documents, langid.fit(documents.where("not held_out")), keep=["doc_id", "held_out"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select(F.col("record_key").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds."""
    marked = decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", F.col("x.item").alias("item_id"), F.col("x.cover").alias("cover"), F.col("x.cosine").alias("cosine"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", noted), F.col("vec_id") % 100 == 0)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH raws AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM raws),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hit AS (SELECT host AS h, path AS p, rh || rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM u LEFT JOIN hit ON h = host AND p = path AND k = 1
"""

_HTTP = warc.HTTP.replace("\r\n", "\\r\\n")
#: record_sha256 is of the whole record: header lines, HTTP head, payload (of a response) and the closing line ends.
OP8_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
x AS (SELECT page_id, url, body, strlen(body) AS payload_bytes, sha1(body) AS code, max(page_id) OVER (PARTITION BY body) AS top FROM p),
y AS (SELECT *, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
  list_aggregate(list_transform(range(32), lambda i: substr('{warc.BASE32}', (('0x' || substr(code, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest FROM x)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, record_type, refers_to,
  sha256(E'WARC/1.1\\r\\nWARC-Type: ' || record_type || E'\\r\\nWARC-Record-ID: <urn:page:' || page_id || E'>\\r\\n' || coalesce('WARC-Refers-To: <urn:page:' || refers_to || E'>\\r\\n', '')
    || coalesce('WARC-Target-URI: ' || replace(replace(url, E'\\r', '%0D'), E'\\n', '%0A') || E'\\r\\n', '') || E'WARC-Date: {warc.DATE}\\r\\nWARC-Payload-Digest: sha1:' || payload_digest
    || E'\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ' || (CASE WHEN record_type = 'response' THEN payload_bytes ELSE 0 END + {len(warc.HTTP)}) || E'\\r\\n\\r\\n{_HTTP}'
    || CASE WHEN record_type = 'response' THEN body ELSE '' END || E'\\r\\n\\r\\n') AS record_sha256
FROM y
"""


OP4_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::INT, 400)) AS m FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
mark AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS f FROM dup),
run AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark) GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM run UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * lo + 1)::INT, (2 * (hi - lo))::INT), '' ORDER BY lo) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
tot AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN tot USING (doc_id)
"""

OP5_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN (
  WITH RECURSIVE r(node, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.reached)
  SELECT node, min(reached) AS component FROM r GROUP BY node) ON node = doc_id
"""


def _op10_sql() -> str:
    picked = lambda x, digits: f"CASE WHEN substr(md5({x}), 1, 1) IN ({', '.join(repr(d) for d in digits)}) THEN chr(10) ELSE '{{}}' END"
    inside = f"array_to_string(list_transform(range(1, length(w) + 1), lambda i: substr(w, i::INT, 1) || CASE WHEN i > 1 THEN {picked('substr(w, (i - 1)::INT, 2)', fingerprint.PAIR).format('')} ELSE '' END), '')"
    cut = f"array_to_string(list_transform(string_split(g, ' '), lambda w: CASE WHEN length(w) > {fingerprint.WORD} THEN {inside} ELSE w END || {picked('w', fingerprint.ENDS).format(' ')}), '')"
    wide = ", ".join(f"sum(('0x' || substr(digest, {8 * i + 1}, 8))::BIGINT)::BIGINT & 4294967295" for i in range(fingerprint.WIDE))
    lanes = ", ".join(f"coalesce(sum(CASE WHEN lane = {i} THEN sign END), 0)::BIGINT" for i in range(fingerprint.LANES))
    form = lambda n: f"array_to_string(list_transform({n}.wide, lambda x: lpad(printf('%x', x), 8, '0')), '') || array_to_string(list_transform({n}.lanes, lambda x: lpad(printf('%x', x & 65535), 4, '0')), '')"
    dot = lambda m, n: f"list_dot_product({m}.lanes::DOUBLE[], {n}.lanes::DOUBLE[])"
    near = lambda n: f"CASE WHEN a.wide = {n}.wide AND a.lanes = {n}.lanes THEN 1.0::DOUBLE WHEN {dot('a', 'a')} * {dot(n, n)} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, {dot('a', n)} / sqrt({dot('a', 'a')} * {dot(n, n)}))) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS nx FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, t, nx, length(t) AS n, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM d),
k AS (SELECT doc_id, 0 AS kind, t AS x FROM e UNION ALL SELECT doc_id, 1, ed FROM e UNION ALL SELECT doc_id, 2, nx FROM e),
i AS (SELECT doc_id, kind, unnest(string_split(regexp_replace(x, '([.!?]) ', '\\1\n', 'g'), '\n')) AS g FROM k),
u AS (SELECT doc_id, kind, sha256(g) AS digest FROM (SELECT doc_id, kind, unnest(string_split(CASE WHEN length(g) > {fingerprint.LONG} THEN {cut} ELSE g END, '\n')) AS g FROM i) WHERE g <> ''),
s AS (SELECT *, (('0x' || substr(digest, 1, 2))::INT % {fingerprint.LANES}) AS lane, CASE WHEN ('0x' || substr(digest, 1, 2))::INT >= 128 THEN 1 ELSE -1 END AS sign FROM u),
v AS (SELECT doc_id, kind, [{wide}] AS wide, [{lanes}] AS lanes FROM s GROUP BY doc_id, kind),
z AS (SELECT doc_id, kind, coalesce(wide, list_transform(range({fingerprint.WIDE}), lambda i: 0::BIGINT)) AS wide, coalesce(lanes, list_transform(range({fingerprint.LANES}), lambda i: 0::BIGINT)) AS lanes FROM (SELECT doc_id, kind FROM k) LEFT JOIN v USING (doc_id, kind))
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.ed) AS edited_sha256, {form('a')} AS fingerprint, {form('b')} AS edited_fingerprint, {near('b')} AS near_edited, {near('c')} AS near_next
FROM e JOIN z a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN z b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN z c ON c.doc_id = e.doc_id AND c.kind = 2
"""


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, id, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.id AS pid, p.score AS pscore, s.id, s.score, row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, pid AS positive_id, k::INT AS rank, id AS negative_id, pscore AS positive_score, score AS negative_score FROM n WHERE k <= 5
"""


def _op13_sql() -> str:
    """Rounds written out: b0 .. b4 are the codebooks, n1 .. n5 the nearest entries."""
    steps = []
    for r in range(1, 6):
        steps.append(f"""d{r} AS (SELECT id, part, entry, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN b{r - 1} USING (part)),
n{r} AS (SELECT id, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY d, entry) AS k FROM d{r}) WHERE k = 1)""")
        if r < 5:
            steps.append(f"""s{r} AS (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS c FROM n{r} JOIN v USING (id, part), range(1, 17) t(i) GROUP BY part, entry, i),
u{r} AS (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS y FROM s{r} GROUP BY part, entry),
b{r} AS (SELECT part, entry, coalesce(u{r}.y, b{r - 1}.y) AS y FROM b{r - 1} LEFT JOIN u{r} USING (part, entry))""")
    return f"""
WITH w AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, part, q[16 * part + 1:16 * part + 16] AS x FROM w, range(4) t(part)),
b0 AS (SELECT part, entry, x AS y FROM v JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM w) USING (id) WHERE entry < 256),
{", ".join(steps).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")},
c AS (SELECT id, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n5 GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM w JOIN c USING (id), h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_url_filter, op3_quality, op4_suffix_dedup, op5_ngram_jaccard, op6_pii, op7_language_id, op8_warc, op9_decontamination, op10_fingerprint, op11_hard_negatives, op12_simhash, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op8_warc": OP8_SQL, "op10_fingerprint": _op10_sql(), "op11_hard_negatives": OP11_SQL, "op13_vector_codes": _op13_sql()}
