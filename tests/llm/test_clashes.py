"""Further columns, whatever their names, disturb no operator."""

import public_tokenizers
from pyspark.sql import functions as F

from lingoloom.llm import bpe, decontam, fingerprint, jaccard, langid, pii, quality, suffix_dedup, urlfilter, warc

NAMES = "key h n c1 c2 k k2 one one_h z best rule verdict host path pii tokens n_tokens lang_pred score leaks keep perplexity threshold _t _m0 _p0 _base _more _k _h _own _id _trusted _b _r _next spans at record_key payload item cover".split()


def test_all(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "http://a.net/es/x", words), (2, words + " more", "en", None, words), (3, "mail a@b.c now", "de", "http://b.com/", None), (4, None, None, "x", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string, html string")
    df = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    items = spark.createDataFrame([(5, " ".join(words.split()[10:40]), 1)], "item_id long, text string, cell int")
    assert bpe.encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 4
    assert urlfilter.judge(df, spark.createDataFrame([("net", "/es/", "block")], "host string, path string, verdict string")).where("verdict = 'block'").count() == 1
    assert quality.classify(df, df.select("doc_id", "k")).count() == 4
    assert suffix_dedup.dedup(df).where("n_removed > 0").count() == 2
    assert {r.component_id for r in jaccard.join(df).collect()} == {1, 3, 4}
    left = jaccard.representatives(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    assert pii.redact(df).where("text = 'mail <email> now'").count() == 1 and pii.find(df).count() == 4
    assert langid.predict(df, langid.fit(df)).where("lang_pred = 'und'").count() == 1
    assert warc.archived(df.withColumnRenamed("doc_id", "page_id")).count() == 4
    assert decontam.leaks(df, items).where("size(leaks) = 1").count() == 2
    assert fingerprint.fingerprints(df).count() == 4
