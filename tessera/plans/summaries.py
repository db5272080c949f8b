"""Inventory, summaries, selections, set relations and text search on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import relational as R

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS records FROM {t}" for t in TABLES))
def table_inventory(table, spark):
    out = None
    for t in TABLES:
        one = table(t).agg(F.count("*").alias("records")).select(F.lit(t).alias("table_name"), "records")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT page_id, strlen(html) AS n_bytes, left(html, 32) AS preview, length(html) > 200 AS truncated FROM pages ORDER BY page_id LIMIT 5""")
def ordered_sample_preview(table, spark):
    return table("pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), F.substring("html", 1, 32).alias("preview"), (F.length("html") > 200).alias("truncated")).orderBy("page_id").limit(5)


@query("""
    SELECT l_suppkey, coalesce(s_name, 'unknown') AS name, records, pairs, least, most, total FROM (
      SELECT l_suppkey, count(*) AS records, count(DISTINCT (l_orderkey, l_partkey)) AS pairs, min(l_quantity) AS least, max(l_quantity) AS most,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
      FROM lineitem GROUP BY l_suppkey) LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def keyed_extent_summary(table, spark):
    facts = table("lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("records"), F.countDistinct("l_orderkey", "l_partkey").alias("pairs"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )
    return facts.join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_suppkey", F.coalesce("s_name", F.lit("unknown")).alias("name"), "records", "pairs", "least", "most", "total")


@query("""
    SELECT reason, count(*) AS records FROM (
      SELECT CASE WHEN text IS NULL THEN 'not_text' WHEN length(text) < 200 THEN 'short' WHEN length(text) > 20000 THEN 'long' WHEN lang NOT IN ('en', 'fr') THEN 'lang' ELSE 'ok' END AS reason FROM documents)
    GROUP BY reason""")
def reject_reason_tally(table, spark):
    n = F.length("text")
    reason = F.when(F.col("text").isNull(), "not_text").when(n < 200, "short").when(n > 20000, "long").when(~F.col("lang").isin("en", "fr"), "lang").otherwise("ok")
    return table("documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("records"))


@query("""SELECT o_orderpriority, records, row_number() OVER (ORDER BY records DESC, o_orderpriority) AS rank FROM (
    SELECT o_orderpriority, count(*) AS records FROM orders GROUP BY o_orderpriority) ORDER BY rank LIMIT 3""")
def histogram_topk_ties(table, spark):
    return R.histogram_topk(table("orders"), "o_orderpriority", 3)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def argmax_record(table, spark):
    return R.argmax(table("orders"), "o_custkey", [F.col("o_totalprice"), -F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


PAIRS = """
    SELECT coalesce(sn.n_name, 'unresolved') AS supplier_nation, coalesce(cn.n_name, 'unresolved') AS customer_nation, sn.n_regionkey AS sr, cn.n_regionkey AS cr
    FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
    LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey"""


def nation_pairs(table):
    """How many line items join each two nations: orders, customers and suppliers by their keys, names after the counts have shrunk the facts."""
    lines = table("lineitem").select("l_orderkey", "l_suppkey")
    orders = table("orders").select("o_orderkey", "o_custkey")
    customers = table("customer").select("c_custkey", "c_nationkey")
    suppliers = table("supplier").select("s_suppkey", "s_nationkey")
    keyed = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    counts = keyed.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    n = table("nation")
    s = n.select(F.col("n_nationkey").alias("_s"), F.col("n_name").alias("_sn"), F.col("n_regionkey").alias("sr"))
    c = n.select(F.col("n_nationkey").alias("_c"), F.col("n_name").alias("_cn"), F.col("n_regionkey").alias("cr"))
    out = counts.join(s, F.col("s_nationkey") == F.col("_s"), "left").join(c, F.col("c_nationkey") == F.col("_c"), "left")
    return out.select(F.coalesce("_sn", F.lit("unresolved")).alias("supplier_nation"), F.coalesce("_cn", F.lit("unresolved")).alias("customer_nation"), "sr", "cr", "n")


@query(f"SELECT supplier_nation, customer_nation, count(*) AS records FROM ({PAIRS}) GROUP BY ALL")
def dual_endpoint_lookup(table, spark):
    return nation_pairs(table).groupBy("supplier_nation", "customer_nation").agg(F.sum("n").alias("records"))


@query(f"SELECT supplier_nation, customer_nation, count(*) AS records FROM ({PAIRS}) WHERE sr = 2 OR cr = 2 GROUP BY ALL")
def either_side_filter(table, spark):
    return nation_pairs(table).filter("sr = 2 or cr = 2").groupBy("supplier_nation", "customer_nation").agg(F.sum("n").alias("records"))


@query("SELECT lang, (doc_id IN (SELECT doc_id FROM labels)) AS known, count(*) AS records FROM documents GROUP BY ALL")
def known_unknown_split(table, spark):
    known = table("labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return table("documents").select("doc_id", "lang").join(known, "doc_id", "left").groupBy("lang", F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("records"))


@query("""SELECT tile, z, height, rotation, count(*) AS records FROM (
    SELECT event_id & 255 AS tile, (event_id >> 8) & 15 AS z, ((event_id >> 12) & 15) + 1 AS height, (event_id >> 4) & 3 AS rotation FROM events) GROUP BY ALL""")
def bit_unpack(table, spark):
    e = F.col("event_id")
    return table("events").groupBy(R.bits(e, 0, 8).alias("tile"), R.bits(e, 8, 4).alias("z"), (R.bits(e, 12, 4) + 1).alias("height"), R.bits(e, 4, 2).alias("rotation")).agg(F.count("*").alias("records"))


TAGS = [("/en/", "english"), (".html", "page"), ("utm_", "tracked"), ("#", "fragment"), ("https:", "secure")]


@query("""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS basename,
    array_to_string(list_filter([%s], lambda x: x IS NOT NULL), ',') AS tags FROM pages""" % ", ".join(f"CASE WHEN contains(url, '{n}') THEN '{t}' END" for n, t in TAGS))
def path_parse_tags(table, spark):
    url = F.col("url")
    tags = F.array_join(F.array(*[F.when(url.contains(n), F.lit(t)) for n, t in TAGS]), ",")
    return table("pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1).alias("basename"), tags.alias("tags"))


@query("""SELECT event_type, count(*) AS records, min(k) AS least, max(k) AS most, sum(k)::BIGINT AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def json_scalar(table, spark):
    k = F.get_json_object("props", "$.k").cast("long")
    return table("events").groupBy("event_type").agg(F.count("*").alias("records"), F.min(k).alias("least"), F.max(k).alias("most"), F.sum(k).alias("total"))


@query("""SELECT event_type, round_even(value / 4, 0) * 4 AS snapped, count(*) AS records, count(DISTINCT user_id) AS users FROM events GROUP BY ALL HAVING count(DISTINCT user_id) >= 2""")
def snap_grid_having(table, spark):
    return table("events").groupBy("event_type", R.snap(F.col("value"), 4).alias("snapped")).agg(F.count("*").alias("records"), F.countDistinct("user_id").alias("users")).filter("users >= 2")


BOUNDS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]


@query("SELECT bucket, count(*) AS records FROM (SELECT CASE " + " ".join(f"WHEN value <= {b} THEN '<={b:g}'" for b in BOUNDS) + " ELSE '>32' END AS bucket FROM events) GROUP BY bucket")
def bucket_ladder(table, spark):
    return table("events").groupBy(R.ladder(F.col("value"), BOUNDS).alias("bucket")).agg(F.count("*").alias("records"))


@query(f"SELECT least(supplier_nation, customer_nation) || ' <-> ' || greatest(supplier_nation, customer_nation) AS pair, count(*) AS records FROM ({PAIRS}) GROUP BY ALL")
def pair_type_histogram(table, spark):
    return nation_pairs(table).groupBy(R.unordered_pair(F.col("supplier_nation"), F.col("customer_nation")).alias("pair")).agg(F.sum("n").alias("records"))


@query("""
    WITH k AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE event_type IN ('click', 'error')),
    s AS (SELECT user_id, day, bool_or(event_type = 'click') AS l, bool_or(event_type = 'error') AS r FROM k GROUP BY ALL)
    SELECT count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right, count(*) FILTER (l AND r) AS both, count(*) AS either FROM s""")
def set_relations(table, spark):
    days = table("events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return R.set_relations(days.filter("event_type = 'click'"), days.filter("event_type = 'error'"), ["user_id", "day"])


@query("""SELECT l_orderkey, count(*) AS records, count(DISTINCT l_linenumber) AS covered, max(l_linenumber)::BIGINT AS expected,
    count(DISTINCT l_linenumber) = max(l_linenumber) AS complete, count(*) - count(DISTINCT l_linenumber) AS surplus FROM lineitem GROUP BY l_orderkey""")
def coverage_group(table, spark):
    return R.coverage(table("lineitem"), "l_orderkey", "l_linenumber")


@query("""
    WITH m AS (SELECT event_type, median(value) AS m, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, any_value(n) AS records, any_value(m) AS median, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rmse, max(abs(value)) AS max_abs,
           greatest(max(value) - any_value(m), any_value(m) - min(value)) AS max_from_median
    FROM events JOIN m USING (event_type) GROUP BY event_type""")
def error_stats(table, spark):
    return R.error_stats(table("events"), "event_type", "value").withColumns({"mean": F.round("mean", 6), "rmse": F.round("rmse", 6)})


@query("""SELECT a.event_type, round(a.m, 6) AS plain_mean, round(b.m, 6) AS balanced_mean FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) a JOIN
    (SELECT event_type, avg(m) AS m FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1) b USING (event_type)""")
def balanced_mean(table, spark):
    users = table("events").groupBy("event_type", "user_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    return users.groupBy("event_type").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("plain_mean"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("balanced_mean"))


@query("""
    SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND lang = 'en' AND source IN ('src0', 'src1', 'src2')""")
def text_search_facets(table, spark):
    from ..operators.search import search

    return search(table("documents"), "The  ING", F.col("text"), {"lang": ["en"], "source": ["src0", "src1", "src2"]}).select("doc_id", "lang", "source")


@query("""
    WITH g AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, min(url) AS a, max(url) AS b, count(*) AS records FROM pages GROUP BY 1),
    n AS (SELECT host, records, a, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS n FROM g)
    SELECT host, records, n::BIGINT AS prefix_length, left(a, n) AS prefix FROM n""")
def common_prefix(table, spark):
    return R.common_prefix(table("pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1)), "host", "url")


@query("""SELECT n_regionkey, sha256(string_agg(n_nationkey || ':' || n_name, chr(10) ORDER BY n_nationkey || ':' || n_name)) AS digest, count(*) AS records FROM nation GROUP BY n_regionkey""")
def ordered_digest(table, spark):
    return R.digest(table("nation"), "n_regionkey", F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name"))


@query("""SELECT event_type, CAST(user_id % 4 AS VARCHAR) AS bucket, count(*) AS records, grouping_id(event_type, user_id % 4)::BIGINT AS level FROM events GROUP BY ROLLUP (event_type, user_id % 4)""")
def rollup_counts(table, spark):
    e = table("events").withColumn("bucket", F.col("user_id") % 4)
    return e.rollup("event_type", "bucket").agg(F.count("*").alias("records"), F.grouping_id().alias("level")).withColumn("bucket", F.col("bucket").cast("string"))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close FROM events GROUP BY event_type""")
def approx_counts(table, spark):
    """Approximate counts and medians beside exact counts: within three of the stated errors, and within two in a thousand ranks."""
    e = table("events")
    about = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.percentile_approx("value", 0.5, 1000).alias("middle"))
    exact = e.join(about.select("event_type", "middle"), "event_type").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("rank"))
    close = F.abs(F.col("about") - F.col("users")) <= 3 * 0.02 * F.col("users") + 1
    return exact.join(about, "event_type").select("event_type", "users", close.alias("users_close"), (F.abs(F.col("rank") - 0.5) <= 0.02).alias("median_close"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'differs' END AS change
    FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality FROM labels WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id
    WHERE a.quality IS DISTINCT FROM b.quality OR a.doc_id IS NULL OR b.doc_id IS NULL""")
def report_diff(table, spark):
    labels = table("labels")  # two versions of a report; the modulo makes them, it limits no work
    a = labels.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("qa"), F.lit(True).alias("a"))
    b = labels.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("qb"), F.lit(True).alias("b"))
    both = a.join(b, "doc_id", "full_outer").filter("a is null or b is null or not (qa <=> qb)")
    return both.select("doc_id", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("differs").alias("change"))
