import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from lingoloom.llm import pii

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text: str) -> list[tuple[int, int, int, str]]:
    found = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text, re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rnd = random.Random(3)
    parts = ["a@b.c", "x_y@e-f.gh.i", "@", ".", "1.2.3.4", "256.1.1.1", "0010.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "é😀", " ", "555-123-4567", "call 555-123-4567", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "12", "-", "\n", "word", "_d@e.f"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    return [*out, None, "", "7" * 30_000, "a" * 50_000, "a@b.c " * 3000, "+" * 1000, "1.2.3.4 " * 700, "a@b.c_d@e.f"]


def test_base_spans_equal_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        want = brute(t or "")
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert set(filter(None, line.split(","))) <= set(rows[i].spans.split(","))
        assert rows[i].n_email == sum(k == "email" for *_, k in want)


def test_added_kinds_need_validators_and_context(spark):
    df = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 x"), (2, "IBAN DE88 3704 0044 0532 0130 00 x"), (3, "please call 555-123-4567"), (4, "part 555-123-4567")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert "iban:5:32" in spans[1] and "iban" not in spans[2]
    assert "localphone:12:24" in spans[3] and "localphone" not in spans[4]


def test_redaction_keeps_other_text_and_columns(spark):
    df = spark.createDataFrame([(1, "to a@b.c, 1.2.3.4!", "k"), (2, None, "k"), (3, "plain", None)], "doc_id long, text string, kind string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "to <email>, <ip>!" and out[1].kind == "k" and out[2].text is None and out[3].text == "plain"


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert pii.report(df).count() == 0
