"""Phrases in one pass, the diff, JSON columns, the tables' comparison, and sinks."""

import hashlib
import http.server
import json
import os
import random
import threading
import time
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lingoloom.functions import diff, maps, scan
from lingoloom.functions import text as tx
from lingoloom.operators import queue as qu
from lingoloom.operators import rules as ru
from lingoloom.plans import catalogue
from lingoloom.sources import sinks


def test_phrases_with_one_first_word(spark):
    """10,000 phrases that start with the same common word, in several shards; texts are read whole and none is taken apart."""
    rnd = random.Random(1)
    phrases = [f"the {a} thing {b}" for a in range(100) for b in range(100)]
    rules = spark.createDataFrame([(i, "terminology", "fr-FR", p, None, "") for i, p in enumerate(phrases)] + [(20_000, "preservation", "fr-FR", "++", None, "x, the 5 THING 5;ab"), (20_001, "style", "fr-FR", "the", None, "the")], "id long, rule_type string, target_language string, source_term string, source_term_standard string, search_keywords string")
    texts = [(i, " ".join(rnd.choice(["the", "The", "x"]) + f" {rnd.randrange(100)} thing {rnd.randrange(120)}" + rnd.choice(["", ".", "s", " ++", "+++"]) for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame(texts, "item_id long, text string")
    got = {(r.item_id, r.rule_id) for r in ru.matches(df, rules).collect()}
    inside = lambda p, t: any(not (t[k - 1 : k] if k else "").isalnum() and not t[k + len(p) : k + len(p) + 1].isalnum() for k in range(len(t)) if t.startswith(p, k))
    want = {(i, k) for i, t in texts for k, p in enumerate(phrases) if p in t.lower() and inside(p, t.lower())}
    want |= {(i, 20_000) for i, t in texts if inside("++", t) or inside("the 5 thing 5", t.lower())}
    assert got == want and want
    hits = scan.found(df, rules.select(F.lower("source_term").alias("needle"), F.lit(scan.PHRASE).alias("kind")), shard=3000)
    assert {(r.item_id, r.needle) for r in hits.collect()} == {(i, phrases[k]) for i, k in want if k < 20_000} | {(i, "++") for i, t in texts if inside("++", t)} | {(i, "the") for i, t in texts if inside("the", t.lower())}
    assert "Generate" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_automaton_equals_the_pattern(spark):
    """What stands in a text is what the pattern for whole words finds."""
    rnd = random.Random(2)
    make = lambda n: "".join(rnd.choice("ab1 -'é.+") for _ in range(n))
    needles = sorted({tx_.strip() for tx_ in (make(rnd.randint(1, 4)) for _ in range(60)) if tx_.strip() and "  " not in tx_})
    texts = [make(rnd.randint(0, 40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in needles], "needle string")))
    want = {(r.item_id, r.needle) for r in df.where(tx.contains_word(F.col("text"), F.col("needle"))).collect()}
    made = scan.automaton([(n, scan.PHRASE) for n in needles])
    assert {(i, needles[k]) for i, t in enumerate(texts) for k in scan.standing(made, t)} == want
    tokens = scan.automaton([("ab", scan.TOKEN), ("a-b", scan.TOKEN)])
    assert [sorted(scan.standing(tokens, t)) for t in ("ab", "x-ab", "ab's", "(ab) a-b", "aab")] == [[0], [], [], [0, 1], []]


@pytest.mark.parametrize("small", [0, 30, 6000])
def test_blocks_are_the_sequence_matchers(monkeypatch, small):
    monkeypatch.setattr(diff, "SMALL", small)
    rnd = random.Random(small)
    for _ in range(700):
        monkeypatch.setattr(diff, "SHORT", rnd.choice([1, 2, 4]))
        v = rnd.choice([2, 3, 10, 50, 300])
        old = [str(rnd.randrange(v)) for _ in range(rnd.choice([0, 1, 5, 40, 120]))]
        new = list(old) if rnd.random() < 0.7 else [str(rnd.randrange(v)) for _ in range(rnd.choice([0, 3, 60]))]
        for _ in range(rnd.randrange(12)):
            if new and rnd.random() < 0.5:
                new.pop(rnd.randrange(len(new)))
            else:
                new.insert(rnd.randrange(len(new) + 1), str(rnd.randrange(v)))
        assert diff.blocks(old, new) == [tuple(m) for m in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks()]


def test_long_pairs_take_seconds():
    rnd = random.Random(3)
    words = [f"w{i} " for i in range(2000)]
    common = [1 / (i + 1) for i in range(2000)]
    old = rnd.choices(words, common, k=20_000)
    pairs = [(old, [w if rnd.random() < 0.95 else rnd.choice(words) for w in old]), (old, rnd.choices(words, common, k=20_000)), (["the "] * 20_000, ["the "] * 10_000 + ["a "] + ["the "] * 9_000)]
    for a, b in pairs:
        began = time.perf_counter()
        got = diff.blocks(a, b)
        assert time.perf_counter() - began < 60
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)


def test_a_batch_of_pairs_needs_little_more_than_its_texts(monkeypatch):
    """What a worker allocates for a batch, besides the batch itself."""
    monkeypatch.setattr(diff, "AT_ONCE", 1 << 14)
    rnd = random.Random(5)
    old = [" ".join(rnd.choices(["the", "a", "thing", "word"], k=400)) for _ in range(250)]
    before, after = pa.array([*old, None, ""]), pa.array([*(t.replace("the", "that") for t in old), "x", None])
    for udf in (diff.pieces, diff.diff):
        held = pa.total_allocated_bytes()
        tracemalloc.start()
        got = udf.func(before, after)
        peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held
        tracemalloc.stop()
        assert len(got) == len(before)
        assert peak < 2 * (before.nbytes + after.nbytes)
    assert diff.pieces.func(before[-2:], after[-2:]).to_pylist() == [[{"kept": False, "first": 1, "n": 1}], []]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_what_is_compared_at_once_changes_nothing(monkeypatch, at_once):
    rnd = random.Random(6)
    pairs = [[" ".join(rnd.choices("abc", k=n)) for n in (rnd.randrange(90), rnd.randrange(90))] for _ in range(60)]
    before, after = (pa.array(x) for x in zip(*pairs, strict=True))
    want = [diff.spans(*p) for p in pairs]
    monkeypatch.setattr(diff, "AT_ONCE", at_once)
    assert diff.diff.func(before, after).to_pylist() == want
    for was, now in pairs:
        assert diff.blocks(diff.tokens(was), diff.tokens(now)) == [tuple(m) for m in SequenceMatcher(None, diff.tokens(was), diff.tokens(now), autojunk=False).get_matching_blocks()]


def test_corrections_are_rebuilt_from_words_taken_apart_once(spark, tmp_path):
    """Words are taken apart once for a text, not inside the lambda for each piece; batches stay small; nulls and blanks count."""
    rows = [(1, "first " + "the word\n" * 300), (2, None), (3, ""), (4, "  a the"), (5, "the the")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    limits = {f"spark.sql.execution.arrow.{k}": most for k, most in (("maxRecordsPerBatch", 10_000), ("maxBytesPerBatch", 64 << 20))}
    for key, most in limits.items():
        spark.conf.set(key, most)
    df = catalogue.queries()["correction_rebuilt"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == plan[: plan.index("lambdafunction(")].count("regexp_extract_all") == 2
    want = {1: "that word\n" * 300, 2: "", 3: "", 4: "a that", 5: "that"}
    assert dict(map(tuple, df.collect())) == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert all(int(spark.conf.get(key).rstrip("b")) < most for key, most in limits.items())


def test_json_columns_keep_types(spark):
    column = '{"a": 1, "b": true, "c": {"x": [1, 2.5, null]}, "d": null, "e": "1", "image_alt": "old"}'
    df = spark.createDataFrame([(column, {"images.image_alt": 'new "x"', "title": "t"}), ("", {"images.image_alt": "n"}), (column, {"title": "t"}), ("[]", {"images.image_alt": "n"}), (None, {"images.image_alt": "n"}), ("no json", {"images.image_alt": "n"})], "images string, translated map<string,string>")
    out = [r[0] for r in df.select(maps.packed(F.col("images"), F.col("translated"), "images.")).collect()]
    assert json.loads(out[0]) == {"a": 1, "b": True, "c": {"x": [1, 2.5, None]}, "d": None, "e": "1", "image_alt": 'new "x"'}
    assert out[2] == column and all(json.loads(out[i]) == {"image_alt": "n"} for i in (1, 3, 4, 5))


def test_strings_compare_without_case_and_accents(spark):
    items = spark.createDataFrame([(1, "L'Été indien"), (2, "ete"), (3, "Straße"), (4, "Ω μέγα"), (5, "Été"), (6, "other")], "id long, title string")
    find = lambda s: sorted(r.id for r in qu.searched(items, s, ["title"]).collect())
    assert (find("ete"), find("ÉTÉ in"), find("strasse"), find("μεγα"), find("é%")) == ([1, 2, 5], [1], [3], [4], [])
    rules = spark.createDataFrame([(1, "Élan"), (2, "ELAN"), (3, "el an")], "id long, source_term string")
    forms = spark.createDataFrame([("elan", "el")], "word string, standard_form string")
    assert {r.id: r.source_term_standard for r in ru.with_standard_terms(rules, forms).collect()} == {1: "el", 2: "el", 3: None}


class Halfway(Exception):
    pass


def test_lines_of_a_repeated_task_are_there_once(spark, tmp_path):
    def broken():
        yield Row(i=1)
        raise Halfway

    writer = sinks.LinesWriter(str(tmp_path), "3")
    with pytest.raises(Halfway):
        writer.write(broken())
    writer.commit([writer.write(iter([Row(i=1), Row(i=2)]))])
    again = sinks.LinesWriter(str(tmp_path), "3")  # the whole batch once more
    again.commit([again.write(iter([Row(i=1), Row(i=2)]))])
    assert [json.loads(x) for x in open(f"{tmp_path}/batch=3/part-00000.json")] == [{"i": 1}, {"i": 2}] and os.listdir(f"{tmp_path}/_work") == []
    spark.dataSource.register(sinks.Lines)
    for _ in range(2):
        spark.range(50).repartition(3).write.format("lines").mode("append").option("batch", "7").save(f"{tmp_path}/x")
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/x/batch=7").collect()) == list(range(50))


def test_forms_are_stored_once(spark, tmp_path):
    known = spark.createDataFrame([("en", "cats", "cat")], "language string, word string, standard_form string")
    found = spark.createDataFrame([("en", "cats", "x"), ("en", "dogs", "dog"), ("en", "dogs", "dog"), ("fr", "cats", "c")], "language string, word string, standard_form string")
    assert [sinks.stored_forms(found, known, str(tmp_path), "1") for _ in range(2)] == [2, 2]
    assert sorted((r.language, r.word) for r in spark.read.parquet(str(tmp_path)).collect()) == [("en", "dogs"), ("fr", "cats")]


def test_posts_report_errors(spark, tmp_path):
    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.headers["Idempotency-Key"], json.loads(body)["id"]))
            self.send_response(200 if json.loads(body)["id"] % 2 else 429)
            self.end_headers()
            self.wfile.write(b"" if json.loads(body)["id"] % 2 else b"slow down")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(sinks.Posts)
    for _ in range(2):
        spark.range(6).write.format("posts").mode("append").option("url", f"http://127.0.0.1:{server.server_port}/").option("report", f"{tmp_path}/report.json").save()
    server.shutdown()
    assert json.load(open(f"{tmp_path}/report.json")) == {"rows": 3, "errors": ["429: slow down"] * 3}
    assert len(seen) == 12 and len(set(seen)) == 6  # again with the same keys
    assert "refused" in sinks.PostsWriter("http://127.0.0.1:9/", None, 2).post(b"{}")
