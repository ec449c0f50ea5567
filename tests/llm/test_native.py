"""URL filter, web archive and fingerprints on small fixtures."""

import base64
import gzip
import hashlib
import random
import re

from lingoloom.llm import fingerprint, urlfilter, warc

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), ("x.net", "", "allow"), (None, "/", "block")]


def verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if h is not None and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_verdicts_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en", "http://a.example.com/en/", "http://xexample.com/en/", "http://net/es/", "http://a.net/es/x", "http://x.net", "http://a.x.net/es/", "http://com:80/", "http://..com/", "://com/?://net/es/", "http://é.com/ü", "http://" + "a." * 3000 + "net/es/" + "b/" * 3000]
    df = spark.createDataFrame([(i % 5, u, "k") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(((r.url or "", r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()), key=repr)
    assert got == sorted([(u or "", *verdict(u)) for u in urls] * 2, key=repr)
    assert {r.verdict for r in urlfilter.judge(df, rules.limit(0), default="block").collect()} == {"block"}
    assert urlfilter.judge(df.limit(0), rules).count() == 0


def test_archive_gives_records_back(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/\r\nX: 1", ""), (5, "u", "x" * 100_000), (2, "again", "<p>é</p>"), (None, "n", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path / "a"))
    out = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted((r.record_key or 0, r.record_type, r.refers_to or 0) for r in out) == [(0, "response", 0), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "revisit", 4), (4, "response", 0), (5, "response", 0)]
    for r in out:
        raw = bytes(r.payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body[n:] == b"\r\n\r\n" and (r.record_type == "revisit" or body[:n].endswith(raw)) and b"\nX: 1" not in head
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    warc.export(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert text.count(b"WARC/1.1\r\n") == 7 and text.endswith(b"\r\n\r\n")
    least = warc.archived(df, least=5).where("record_type = 'revisit'").collect()
    assert [r.record_key for r in least] == [1] and warc.archived(df.limit(0)).count() == 0


def test_damaged_payloads_are_refused(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("address", "cast('tent' as binary) payload", "response_key", "payload_sha1", "payload_bytes").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(spark, str(tmp_path / "b")).collect()


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 3)
    rnd = random.Random(6)
    texts = {i * rnd.choice([1, 7]) + i: "\n".join(f"Line {rnd.randrange(40)} é." for _ in range(rnd.randint(0, 12))) for i in range(40)}
    texts[1000] = None
    ids = sorted(texts)
    df = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert out[i].n_chars == len(own) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    assert out[1000].fingerprint == "0" * (8 * fingerprint.WIDE + 4 * fingerprint.LANES)
    alone = fingerprint.fingerprints(spark.createDataFrame([(None, "a. b"), (None, "b\na.")], "doc_id long, text string")).collect()
    assert alone[0].fingerprint == alone[1].fingerprint  # the same paragraphs in another order
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_insertion_and_deletion(spark):
    from pyspark.sql import functions as F

    v = lambda t: fingerprint.vectors(spark.createDataFrame([(1, t)], "id long, text string"), ["id"], "text")
    whole, part = v("one\ntwo\nthree").first(), v("one\nthree").first()
    one = spark.createDataFrame([(part.wide, part.lanes, *v("two").select("wide", "lanes").first())], "w array<long>, l array<long>, x array<long>, y array<long>")
    wide, lanes = fingerprint.combine(F.col("w"), F.col("l"), F.col("x"), F.col("y"))
    added = one.select(wide, lanes).first()
    assert tuple(added) == (whole.wide, whole.lanes)
    back = one.select(wide.alias("w"), lanes.alias("l"), "x", "y").select(*fingerprint.combine(F.col("w"), F.col("l"), F.col("x"), F.col("y"), -1)).first()
    assert tuple(back) == (part.wide, part.lanes)


def test_next_rows_whatever_the_ids(spark, monkeypatch):
    """Sparse, repeated, null and string ids: the next text is that of plain Python, and no bucket holds most rows."""
    import datetime

    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "BUCKET", 16)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(8))
    tables = {
        "long": [(i, word()) for i in range(400)] + [(1 << 60, "far"), (-5, "low")],
        "string": [(f"http://site/{rnd.randrange(10**6)}", word()) for _ in range(400)] + [("", "e"), ("é", "x")],
        "bigint": [(7, word()) for _ in range(300)] + [(i, word()) for i in range(60)] + [(None, word()) for _ in range(150)] + [(9, "same")] * 30,
        "double": [(rnd.random(), word()) for _ in range(100)],
        "date": [(datetime.date(2020, 1, 1) + datetime.timedelta(rnd.randrange(3000)), word()) for _ in range(100)],
    }
    for kind, rows in tables.items():
        df = spark.createDataFrame(rows, f"id {kind}, text string").repartition(4)
        made, _ = fingerprint.with_next(df, "id", "text", "after")
        order = sorted(rows, key=lambda r: (r[0] is None, (r[0].encode() if isinstance(r[0], str) else r[0]) if r[0] is not None else 0, r[1].encode()))
        want = sorted((str(k), t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
        assert sorted((str(r.id), r.text, r.after) for r in made.collect()) == want
        assert made.groupBy("_b").count().agg(F.max("count")).first()[0] <= 100


def cut(line):
    """A long line's units: after words, and after pairs of code points of long words, that their hash picks."""
    first = lambda x: hashlib.md5(x.encode()).hexdigest()[0]
    if len(line) <= fingerprint.LONG:
        return [line]
    out = ""
    for w in line.split(" "):
        if len(w) > fingerprint.WORD:
            out += w[0] + "".join(c + ("\n" if first(b + c) in fingerprint.PAIR else "") for b, c in zip(w, w[1:], strict=False))
        else:
            out += w
        out += "\n" if first(w) in fingerprint.ENDS else " "
    return out.split("\n")


def test_fingerprints_equal_plain_python(spark):
    def vector(text):
        wide, lanes = [0] * fingerprint.WIDE, [0] * fingerprint.LANES
        lines = re.sub(r"([.!?]) ", "\\1\n", text or "").split("\n")
        for unit in filter(None, (u for x in lines for u in cut(x))):
            digest = hashlib.sha256(unit.encode()).digest()
            wide = [(w + int.from_bytes(digest[4 * i : 4 * i + 4], "big")) % 2**32 for i, w in enumerate(wide)]
            lanes[digest[0] % fingerprint.LANES] += 1 if digest[0] >= 128 else -1
        return wide, lanes

    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["One. ", "Two! ", "é\n", "x", "same line\n"]) for _ in range(rnd.choice([0, 3, 40, 4000]))) for _ in range(60)] + [None, "same line\n" * 30_000]
    texts += ["".join(rnd.choice(["water ", "one ", "слово ", "et,  ", "字，", "字", "语文"]) for _ in range(rnd.choice([20, 60, 5000]))) for _ in range(40)]
    texts += ["".join(rnd.choice("字语文本很长กขคงจ😀") for _ in range(3000)) + rnd.choice([" ", ""]) for _ in range(5)] + ["x" * 119 + " ", "y" * 5000]
    ids = [f"d{i:03}" for i in range(len(texts))]
    out = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string")).collect()}
    for k, i in enumerate(ids):
        own, after = texts[k] or "", texts[(k + 1) % len(ids)] or ""
        half = len(own) // 2
        a, e, n = (vector(t) for t in (own, own[: len(own) - half] + after[:half], after))
        form = lambda v: "".join(f"{x:08x}" for x in v[0]) + "".join(f"{x % 65536:04x}" for x in v[1])
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (form(a), form(e))
        for got, v in ((out[i].near_edited, e), (out[i].near_next, n)):
            dot = lambda x, y: sum(p * q for p, q in zip(x[1], y[1]))
            norm = dot(a, a) * dot(v, v)
            assert abs(got - (1.0 if a == v else 0.0 if not norm else min(1.0, max(0.0, dot(a, v) / norm**0.5)))) < 1e-9


def test_one_line_keeps_its_likeness(spark):
    """A long text without line or sentence ends stays like itself when half of it, or one word at its beginning, changes."""
    rnd = random.Random(4)
    words = ["water", "light", "stone", "great", "bread", "under", "about", "night"]
    line = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(9)) + rnd.choice(["t", "r", "n", "s", "e"]) for _ in range(n))
    rows = [(i, line(400)) for i in range(12)]
    out = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(0.3 < r.near_edited < 0.8 and r.near_next < 0.3 for r in out)
    text = rows[0][1]
    made = fingerprint.fingerprints(spark.createDataFrame([(1, text), (2, "first " + text)], "doc_id long, text string")).orderBy("doc_id").first()
    assert 0.9 < made.near_next < 1


def test_any_script_keeps_its_likeness(spark):
    """A text in one line, without stops, of any script: half edited it is nearer to itself than to the next one."""
    rnd = random.Random(5)
    scripts = {"en": "abcdefghijklmnopqrstuvwxyz", "hi": "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "th": "กขคงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ", "zh": "".join(chr(0x4E00 + i) for i in range(0, 3000, 3)), "mix": "abxyзя字ก"}
    rows = []
    for letters in scripts.values():
        spaced = letters not in (scripts["th"], scripts["zh"])
        for _ in range(3):
            words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(400)]
            rows.append((len(rows), (" " if spaced else "").join(rnd.choice(words) for _ in range(500))))
    out = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(r.near_edited > r.near_next + 0.1 for r in out)
    # 128 lanes estimate the half with a deviation of 0.09
    assert all(0.35 < sum(r.near_edited for r in out[i : i + 3]) / 3 < 0.65 for i in range(0, len(out), 3))


def test_rules_have_a_border_between_host_and_path(spark):
    rules = [("example.co", "m/", "block"), ("example.org", "/", "allow"), ("bad#", "/", "block"), ("bad", "#/", "block")]
    rules += [(f"site{i}.net", f"/{i}/", "block") for i in range(300)]
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = ["http://example.com/", "http://example.org/x", "http://bad#/", "http://bad/", "http://a.site7.net/7/x", "http://site7.net/8/", "http://site7.net/7/" + "x" * 100_000]
    for most in (urlfilter.BROADCAST_RULES, 10):
        old, urlfilter.BROADCAST_RULES = urlfilter.BROADCAST_RULES, most
        try:
            got = {r.url: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), df).collect()}
        finally:
            urlfilter.BROADCAST_RULES = old
        assert [got[u] for u in urls] == [(None, "allow"), ("example.org/", "allow"), (None, "allow"), (None, "allow"), ("site7.net/7/", "block"), (None, "allow"), ("site7.net/7/", "block")]
