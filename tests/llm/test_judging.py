import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_classifier, quality_rules, toxicity, url_filter
from tessera.llm.common import prepare
from tessera.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), len(again)


def test_statistics(spark, docs, texts, labels):
    prepare(spark)
    rows = quality_rules.quality_rules(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1 and None in got
    for i, t in texts.items():
        r, want = got[i], plain_statistics(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_rules_are_found_and_ordered(spark):
    rows = [dict.fromkeys(quality_rules.FEATURES, 0.0) | {"symbols_per_word": k / 100, "label": int(k < 60)} for k in range(100)] * 3
    rules = quality_rules.learn(rows)
    assert rules and all(c.feature == "symbols_per_word" for rule in rules for c in rule)
    df = spark.createDataFrame([(0.1,), (0.9,)], "symbols_per_word double")
    assert [r[0] for r in df.select(quality_rules.verdict(rules)).collect()] == [True, False]
    assert quality_rules.learn([]) == [] and quality_rules.learn(rows[:10]) == []


def test_rules_need_no_python_on_executors(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality_rules.quality_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def plain_verdict(url):
    url = url or ""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in URL_RULES if path.startswith(r[r.index("/") :]) and (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")]))]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


URLS = [None, "", "no scheme", "http://", "http://com/en/", "HTTPS://A.Example.COM/en/7x?y#z", "http://xcom/en/", "http://b.com/en", "http://example.net/de/8/9", "http://m.example.net/de/7", "ftp://x.org/es/?q", "http://x.org?/es/", "a://b://com/en/"]


def test_url_filter(spark):
    prepare(spark)
    urls = URLS + [f"http://h{k}.example.{t}/{l}/{k}" for k in range(40) for t in ("com", "net", "org") for l in ("en", "de", "es")]
    df = spark.createDataFrame([(k, u, "h", "p", "k") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, keys string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, URL_RULES).collect()}
    assert got == {k: plain_verdict(u) for k, u in enumerate(urls)}
    assert url_filter.url_filter(df.limit(0), URL_RULES).collect() == []
    assert {r["verdict"] for r in url_filter.url_filter(df, []).collect()} == {"allow"}


def test_beyond_the_limit_rows_are_judged_each(spark):
    prepare(spark)
    rules = URL_RULES + [("block", "net/de/"), ("allow", "org/es/")]
    rows = [(1, "http://x.com/en/1")] * 3 + [(2, "http://a.net/de/1"), (None, "http://a.org/es/1"), (None, "http://a.org/es/1"), (3, None), (3, None), (4, "http://q/x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    small, large = ([tuple(r) for r in url_filter.url_filter(df, rules, most_bytes=m).collect()] for m in (0, url_filter.MOST_BYTES))
    assert sorted(small, key=str) == sorted(large, key=str) and len(small) == len(rows)
    assert {r[4] for r in small if r[3] in ("net/de/", "org/es/")} == {"allow"}


def test_cascade_is_exact_and_bounded(spark):
    universe = spark.range(3000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    listed = universe.filter(F.crc32("key") % 7 == 0)
    c = url_filter.Cascade.build(listed, universe)
    assert len(c.levels) > 1
    wrong = universe.filter(c.contains(F.col("key")) != (F.crc32("key") % 7 == 0))
    assert wrong.count() == 0
    assert url_filter.Cascade.build(listed, universe, most_bytes=10) is None


GOOD, BAD = "the quiet river runs to the sea and the old town sleeps", "BUY!! NOW!! %%% CLICK!! ### WIN!! $$$ FREE!!"


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(k, " ".join([GOOD if k % 2 else BAD] * (1 + k % 3)) + (" you idiotic fool" if k % 5 == 0 else " a kind word")) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))


def test_quality_learns(taught):
    rows = quality_classifier.quality_scores(*taught).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["held_out"])


def test_toxicity_learns_and_carries_over_to_misspellings(spark, taught):
    rows = toxicity.toxicity_scores(*taught).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in rows if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in rows)
    model = toxicity.fit(*taught, 5, 0)
    unseen = spark.createDataFrame([(1, GOOD + " you idiotik foool"), (2, GOOD + " a kind word")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(unseen, model).collect()}
    assert s[1] > 0.5 > s[2]


def test_labels_of_the_held_out_fold_teach_nothing(taught):
    df, labels = taught
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_classifier.fit(df, labels, 4, 2) == quality_classifier.fit(df, other, 4, 2)).all()


def test_edges(spark, docs, texts, empty, labels):
    prepare(spark)
    for f in (quality_classifier.quality_scores, toxicity.toxicity_scores):
        got = {r["doc_id"]: r["score"] for r in f(docs, labels).collect()}
        assert got.keys() == texts.keys() and all(0 <= s <= 1 for s in got.values())
        assert f(empty, labels).collect() == []
        assert {r["score"] for r in f(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_rules.quality_rules(empty, labels).collect() == []
