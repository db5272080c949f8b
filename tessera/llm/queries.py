"""The operators bound to the driver's tables: one query for each, with production parameters, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .collocations import collocations
from .common import table
from .exact_dedup import exact_dedup
from .ngram_join import ngram_join
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .token_files import read_token_files, write_token_files
from .toxicity import toxicity_scores
from .url_filter import url_filter

#: Fixed by the contract of op4.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_quality_rules, op2_substring_dedup, op3_exact_dedup, op4_url_filter, op5_quality_classifier, op6_ngram_join, op7_packing)
    return {f.__name__: f for f in (*first, op8_token_files, op9_byte_bpe, op10_toxicity, op11_simhash, op12_collocations, op13_prefix_trie)}


#: Plain SQL for the operators whose whole result it can express.
ORACLE_SQL = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS s FROM d),
        windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM starts),
        least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM windows JOIN least USING (k) WHERE m < doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_exact_dedup": """
        WITH t AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM t""",
    "op4_url_filter": r"""
        WITH rules(v, r) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
        parts AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        hits AS (
          SELECT page_id, max({'n': length(r), 'r': r, 'v': v}) AS hit
          FROM (SELECT DISTINCT page_id, host, path FROM parts)
          JOIN rules ON starts_with(path, substr(r, instr(r, '/'))) AND ends_with('.' || host, '.' || substr(r, 1, instr(r, '/') - 1))
          GROUP BY page_id)
        SELECT page_id, host, path, hit.r AS rule, coalesce(hit.v, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)""",
    "op12_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        spans AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM spots),
        grams AS (SELECT lang, k, w[i:i + k - 1] AS p, count(*)::HUGEINT AS f FROM spans GROUP BY ALL),
        cand AS (SELECT lang, p, k, f AS a FROM grams WHERE k > 1 AND f >= 30),
        inner_spots AS (SELECT lang, p, k, a, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
        inners AS (SELECT lang, a, m, p, unnest(range(1, k - m + 2)) AS i FROM inner_spots),
        cover AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer FROM inners GROUP BY ALL),
        kept AS (SELECT c.* FROM cand c LEFT JOIN cover USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a),
        cuts AS (SELECT lang, p, a, unnest(range(1, k)) AS c, k FROM kept),
        sides AS (
          SELECT t.lang, t.p, a, c, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score
          FROM cuts t JOIN grams x ON x.lang = t.lang AND x.p = t.p[1:c] JOIN grams y ON y.lang = t.lang AND y.p = t.p[c + 1:t.k]),
        least AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM sides QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    # crc32 of the decimal id: eight shifts a byte, the byte mixed in before the first of them
    "op13_prefix_trie": """
        WITH t AS (
          SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', role, text))) AS i,
                 {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
          FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (
          SELECT conv, flatten(list_transform(string_split(conv::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS steps FROM (SELECT DISTINCT conv FROM t)),
        heads AS (
          SELECT conv, xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda c, s: xor(xor(c, s) >> 1, 3988292384 * (xor(c, s) & 1))), 4294967295) % 6 AS h FROM ids),
        given AS (SELECT heads.conv, t.i, t.x FROM heads JOIN t ON t.conv = heads.conv - heads.conv % 100 AND t.i <= h),
        own AS (SELECT t.conv, 10 + t.i AS i, t.x FROM t JOIN heads USING (conv) WHERE t.i > h),
        built AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY i) AS d, x FROM (FROM given UNION ALL FROM own)),
        seqs AS (SELECT conv, list(x ORDER BY d) AS s FROM built GROUP BY conv),
        whole AS (SELECT heads.conv, coalesce(s, []) AS s FROM heads LEFT JOIN seqs USING (conv)),
        prefixes AS (SELECT conv, s, unnest(range(0, len(s) + 1)) AS d FROM whole),
        rows AS (SELECT conv, d, s[1:d] AS p, len(s) = d AS is_end FROM prefixes),
        nodes AS (
          SELECT d, p, min(conv) AS conv, count(*) AS n_convs, sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (is_end), '')) AS ends_sha256
          FROM rows GROUP BY d, p),
        children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
        known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN nodes.d > 0 THEN (n_convs - 1) * length(nodes.p[nodes.d].t) ELSE 0 END AS saved FROM nodes LEFT JOIN children USING (d, p)),
        above AS (SELECT n_children, saved, p, unnest(range(0, d + 1)) AS d FROM known),
        sums AS (SELECT d, p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
        SELECT known.conv AS conv_id, known.d AS depth, up.conv AS parent_conv_id, known.n_convs, known.n_children, n_leaves, saved_tokens, known.ends_sha256
        FROM known JOIN sums USING (d, p) LEFT JOIN nodes up ON up.d = known.d - 1 AND up.p = known.p[1:known.d - 1]""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
