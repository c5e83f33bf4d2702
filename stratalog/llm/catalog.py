"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import site_quality
from .archives import archive_round_trip
from .bpe import bpe_round_trip
from .common import documents
from .importance import resampled
from .interleave import interleaved_media
from .log_bilinear import text_scores
from .main_text import main_text
from .near_dedup import near_duplicates
from .packing import pack_pieces
from .periodic import periodic_runs, repeated_tail
from .quality_rules import quality_rules
from .sharding import shard_by_bytes
from .toxicity import fit, toxicity_scores

#: Folder of the public vocabulary files, on every executor.
TOKENIZERS = os.environ.get("STRATALOG_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


_SHINGLES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, fit(docs.select("doc_id", "text"), documents(spark, sf_dir, "labels")))


@query("op2_hilbert_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")


_ARCHIVES = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p),
digit AS (SELECT d.page_id, i, instr('0123456789abcdef', substr(hex, i, 1)) - 1 AS v FROM d, range(1, 41) AS t(i)),
bits AS (SELECT page_id, string_agg(lpad(bin(v), 4, '0'), '' ORDER BY i) AS bits FROM digit GROUP BY 1),
base32 AS (SELECT page_id, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 5 * k + j + 1, 1)::INT << (4 - j)))::INT, 1)), '') AS digest FROM bits)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM d JOIN base32 USING (page_id)
"""


@query("op3_warc_zip", _ARCHIVES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(documents(spark, sf_dir, "pages"))


@query("op4_minhash_near_dedup", _SHINGLES)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


@query("op5_site_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, its path the source and language."""
    docs = documents(spark, sf_dir)
    model = site_quality.fit(docs.select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return site_quality.site_quality(docs, model, F.col("source"), F.col("lang"))


@query("op6_bpe_round_trip")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), f"{TOKENIZERS}/word_bpe_49k.json")


_RULES = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
gram AS (
  SELECT doc_id, ws, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(ws[i:i + 4], ' '))) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM gram, range(5) AS t(d) WHERE n > 1 GROUP BY 1),
far AS (
  SELECT doc_id, count(DISTINCT i + d) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(ws[i:i + 9], ' '))) AS n FROM gram WHERE n > 1 AND i + 9 <= len(ws)), range(10) AS t(d)
  WHERE n > 1 GROUP BY 1),
long AS (  -- a repeat of 101 words begins where one of 5 begins
  SELECT DISTINCT doc_id FROM gram WHERE n > 1 AND i + 100 <= len(ws)
  GROUP BY doc_id, md5(array_to_string(ws[i:i + 100], ' ')) HAVING count(*) > 1),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(f.n, 0)::BIGINT AS n_long_words, l.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN far f ON f.doc_id = w.doc_id LEFT JOIN long l ON l.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_long_words, too_long,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR too_long OR 100 * n_long_words > 10 * n_words) AS kept
FROM base
"""


@query("op9_suffix_array_rules", _RULES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("covered_fraction", "longest_repeat")  # what SQL can't say in reasonable time


@query("op7_interleaved_media")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_media(documents(spark, sf_dir))


@query("op8_sampled_splitters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir))


@query("op10_host_suffix_array")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(documents(spark, sf_dir, "pages"))


@query("op11_log_bilinear")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(documents(spark, sf_dir))


#: CRC-32 of texts: the table by eight halvings of each byte, then one step for each byte of the UTF-8 form.
_CRC = r"""byte(i, c) AS (SELECT i::BIGINT, i::BIGINT FROM range(256) t(i)),
halved AS (SELECT i, c, 0 AS n FROM byte UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n + 1 FROM halved WHERE n < 8),
tbl AS (SELECT list(c ORDER BY i) AS tbl FROM halved WHERE n = 8)"""
_crc = lambda hex_: f"xor(list_reduce(list_transform(range(0, len({hex_}) // 2), lambda i: ('0x' || substr({hex_}, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"

_PERIODIC = rf"""
WITH RECURSIVE {_CRC},
w AS (SELECT *, len(ws) AS n, row_number() OVER () AS r FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
h AS (SELECT *, {_crc("x")} AS h FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS x FROM w), tbl),
a AS (SELECT *, h // 10 % n AS a FROM h WHERE h % 10 = 0 AND n > 0),
p AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM a),
d AS (SELECT r, doc_id, list_concat(ws[:a], list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1])) AS ws FROM p
  UNION ALL SELECT r, doc_id, ws FROM h WHERE h % 10 <> 0 OR n = 0),
g AS (SELECT r, len(ws) AS n, unnest(range(0, len(ws) - 4)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))) AS g FROM d),
-- windows that recur a period on; a run of four periods and six words has two of them or more
q AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON y.r = x.r AND y.g = x.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
every AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT k.r, string_agg(k.w, ' ' ORDER BY k.i) AS text FROM (SELECT r, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM d) k ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(e.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best b USING (r) LEFT JOIN every e USING (r) LEFT JOIN kept k USING (r)
"""


@query("op12_periodic_runs", _PERIODIC)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), repeated_tail)


_RESAMPLED = rf"""
WITH RECURSIVE {_CRC},
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
w AS (SELECT side, doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts),
f AS (SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) AS g FROM w),
crc AS (SELECT g, {_crc("x")} % 10000 AS bucket FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)), tbl),
fb AS (SELECT side, r, bucket FROM f JOIN crc USING (g)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM fb GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
weight AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(ws) >= 20 AS able,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * (SELECT count(*) FROM scored WHERE able) // 100 THEN place END AS rank FROM ranked
"""


@query("op13_importance_resampling", _RESAMPLED)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
