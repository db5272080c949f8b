import corpus_pipeline as c
from tessera.llm.common import stored


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = c.table(spark, d, "documents")
    columns, before = docs.columns, None
    for name, stage in c.STAGES:
        out = stored(stage(spark, docs, d), "test-stage")
        if name != c.STAGES[-1][0]:
            assert out.columns == columns and out.schema == docs.schema
            ids = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert ids and (before is None or ids <= before)
            before = ids
        docs = out
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == before


def test_empty(spark):
    d = "/root/testdata/sf0.001"
    docs = c.table(spark, d, "documents").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, d)
    assert docs.collect() == []


def test_rows_that_repeat_an_id(spark):
    """Each row goes or stays by its own text."""
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    base, other, passage = words("w", 60), words("other", 60), words("p", 20)

    def after(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        out = stage(spark, docs, None)
        assert out.schema == docs.schema
        got = out.collect()
        assert all(r["n_chars"] == len(r["text"]) for r in got)
        return sorted(((r["doc_id"], r["text"]) for r in got), key=str)

    rows = [(1, "same text"), (1, "only here"), (2, "same text"), (3, "twice"), (3, "twice"), (None, "twice"), (None, "twice")]
    assert after(c.exact_copies, rows) == sorted([(1, "only here"), (2, "same text"), (3, "twice"), (None, "twice"), (None, "twice")], key=str)
    rows = [(1, base), (2, base.replace("w30", "changed")), (2, other), (4, other.replace("other30", "changed")), (None, base)]
    assert after(c.near_copies, rows) == sorted([(1, base), (2, other), (None, base)], key=str)
    rows = [(1, passage + " first end"), (2, passage + " second end"), (2, other), (2, passage), (3, other + " tail"), (None, passage)]
    assert after(c.repeated_passages, rows) == sorted([(1, passage + " first end"), (2, "second end"), (2, other), (3, "tail"), (None, passage)], key=str)


def test_row_numbers_follow_the_ids(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(400)] + [(None, "no id")], "doc_id long, text string").repartition(7)
    rows, key = c.told_apart(docs)
    got = sorted((r[key], r["doc_id"], r["text"]) for r in rows.filter("doc_id is not null").collect())
    assert [x[1:] for x in got] == sorted(x[1:] for x in got) and len({x[0] for x in got}) == 400
    assert rows.filter("doc_id is null and _row is null").count() == 1
