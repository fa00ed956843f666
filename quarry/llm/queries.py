"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, tokenizer_path
from quarry.llm.decontaminate import contamination
from quarry.llm.divergence import audit
from quarry.llm.exact_dedup import deduplicate
from quarry.llm.language import identify
from quarry.llm.lattice import score_texts
from quarry.llm.licenses import scan as scan_licenses
from quarry.llm.minhash import near_duplicates as minhash_duplicates
from quarry.llm.packing import pack
from quarry.llm.rolling import document_windows
from quarry.llm.secrets import digests
from quarry.llm.secrets import scan as scan_secrets
from quarry.llm.simhash import as_hex, near_duplicates
from quarry.llm.url_filter import judge_pages
from quarry.llm.warc import round_trip


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), width=4, seed=42, distance=4)
    return out.select("doc_id", as_hex(F.col("w0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), hold_out=(3, 1))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(table(spark, sf_dir, "documents")))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), hold_out=(7, 2))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, null_ids=True)
    return out.select("row.doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256", (F.col("found.n_hit") > 0).alias("contaminated"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=4096, end_id=1)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("keep_chars")


def op11_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_windows(table(spark, sf_dir, "documents"), windows=(600, 43200))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def queries() -> dict:
    every = op1_simhash, op2_language_id, op3_urls, op4_secrets, op5_lattice, op6_warc, op7_licenses, op8_decontaminate, op9_pack, op10_exact_dedup, op11_rolling, op12_minhash, op13_divergence
    return {f.__name__: f for f in every}


#: DuckDB. Only what SQL expresses for whole tables.
_OP10 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS rn,
             first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size
      FROM t)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(body) AS text_sha256 FROM k
"""


_OP6 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(digest, 1 + 5 * (i // 4), 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT) % 32)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, s.n AS n, array_to_string(w[i + 1:i + s.n], ' ') AS body
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw)) s),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.body = bw.body AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: crc32 bit by bit: eight steps for each digit.
_OP11 = r"""
WITH c AS (
  SELECT doc_id, text, lang, source,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
e AS (SELECT doc_id, lang, source, length(text)::BIGINT AS chars, (10 * ((doc_id + h % 10000) - (((doc_id + h % 10000) % 6) + 6) % 6))::BIGINT AS event_s FROM c),
w AS (
  SELECT doc_id, event_s, 600 AS window_s, count(*) OVER r AS n_events, sum(chars) OVER r AS total, count(DISTINCT lang) OVER r AS n_langs, list(chars) OVER r AS every
  FROM e WINDOW r AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 600 PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT doc_id, event_s, 43200, count(*) OVER r, sum(chars) OVER r, count(DISTINCT lang) OVER r, list(chars) OVER r
  FROM e WINDOW r AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 43200 PRECEDING AND 1 PRECEDING)),
s AS (SELECT * EXCLUDE (every), list_sort(list_filter(coalesce(every, []), lambda x: x IS NOT NULL)) AS v FROM w)
SELECT doc_id, window_s::BIGINT AS window_s, event_s, n_events::BIGINT AS n_events, coalesce(total, 0)::BIGINT AS sum_chars, n_langs::BIGINT AS n_langs,
       v[((len(v) + 1) // 2)::INTEGER] AS median_chars, v[((90 * len(v) + 99) // 100)::INTEGER] AS high_chars
FROM s
"""

_OP12 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT n, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i::INTEGER] || ' ' || w[i::INTEGER + 1])) END AS s FROM d),
t AS (SELECT n, unnest(s) AS t FROM s),
shared AS (SELECT a.n AS a, b.n AS b, count(*) AS meet FROM t a JOIN t b ON a.t = b.t AND a.n <> b.n GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN s x ON x.n = a JOIN s y ON y.n = b WHERE 100 * meet >= 80 * (len(x.s) + len(y.s) - meet)),
reach AS (SELECT n AS a, n AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
root AS (SELECT reach.a AS n, min(s.doc_id) AS component_id FROM reach JOIN s ON s.n = reach.b GROUP BY ALL)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN root USING (n)
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT n, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT n) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, coalesce(sum(c), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + ((1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (size.total + 2 * v)) AS p, 1 + ((1000000000::HUGEINT * (kept.total + 2)) // (v.total + 2 * v)) AS q
  FROM size JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS one, b.source AS two, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS s
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND one = a.source AND two = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": _OP6, "op8_decontaminate": _OP8, "op10_exact_dedup": _OP10, "op11_rolling": _OP11, "op12_minhash": _OP12, "op13_divergence": _OP13}
