"""Inputs that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.versions import CALENDAR, PAIRS, version_date
from quarry.workers import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 20, against all rows."""
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def calendar_at(i: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v, _ in CALENDAR)), F.pmod(i, F.lit(len(CALENDAR))).cast("int"))


def source_version() -> Column:
    """A source stands for a file of the version that its number picks from the calendar."""
    return calendar_at(F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0)))


def chunk_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk: its source is the file, its language the document, and its id gives the chunk index, so that files have
    chunks at the same places."""
    d = table(spark, sf_dir, "documents").withColumn("version", source_version())
    rows = d.select("doc_id", F.col("lang").alias("document_name"), "version", version_date(F.col("version")).alias("version_date"), F.col("source").alias("source_file"), F.expr("doc_id div 40").alias("chunk_index"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    return rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "document_name", "version", "version_date", F.concat(F.lit("Section "), (F.col("chunk_index") + 1).cast("string")).alias("section_header"), "source_file", "chunk_index", "checksum")


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "old string, new string")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as the record of a retrieval: its priority picks the wording of the query, its keys the versions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", calendar_at(F.col("o_custkey")).alias("v"), calendar_at(F.col("o_orderkey")).alias("r"), (F.col("o_custkey") % 7).cast("int").alias("n"))
    p = F.substring("o_orderpriority", 1, 1)
    query = F.when(p == "1", F.concat(F.lit("Compare "), F.col("v"), F.lit(" with the one before"))).when(p == "2", F.lit("History of the planner")).when(p == "3", F.concat(F.lit("What is in "), F.col("v"))).when(p == "4", F.lit("What was fixed in the reader")).otherwise(F.lit("How do I open a file"))
    late = version_date(F.col("r")) > version_date(F.col("v"))
    return o.select(F.col("o_orderkey").alias("query_id"), query.alias("query"), F.col("v").alias("expected_version"), F.when(F.col("n") == 0, "none").otherwise(F.col("r")).alias("retrieved_version"), F.least("n", F.lit(5)).alias("retrieved_chunks"), (late & (F.col("n") > 0)).alias("temporal_leak"), (F.col("o_totalprice") / 1000).alias("retrieval_latency_ms"))


# --- the same in SQL -----------------------------------------------------------------------------------------------
_VERSIONS = "[" + ", ".join(f"'{v}'" for v, _ in CALENDAR) + "]"
CAL_SQL = "cal(version, version_date) AS (VALUES " + ", ".join(f"('{v}', DATE '{d}')" for v, d in CALENDAR) + ")"
PAIRS_SQL = 'pairs("old", "new") AS (VALUES ' + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")"
DOC_VERSION_SQL = f"({_VERSIONS})[1 + coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INT), 0) % 12]"
CHUNKS_SQL = f"""{CAL_SQL},
cv0 AS (
  SELECT doc_id, 'd' || doc_id AS chunk_id, lang AS document_name, {DOC_VERSION_SQL} AS version,
         source AS source_file, doc_id // 40 AS chunk_index, sha256(coalesce(text, '')) AS checksum
  FROM documents),
cv AS (SELECT cv0.*, version_date, 'Section ' || (chunk_index + 1) AS section_header FROM cv0 JOIN cal USING (version))"""
FACTS_SQL = f"""{CAL_SQL},
o AS (SELECT o_orderkey, o_totalprice, substr(o_orderpriority, 1, 1) AS p, ({_VERSIONS})[1 + o_custkey % 12] AS v, ({_VERSIONS})[1 + o_orderkey % 12] AS r, o_custkey % 7 AS n FROM orders),
facts AS (
  SELECT o_orderkey AS query_id,
         CASE p WHEN '1' THEN 'Compare ' || v || ' with the one before' WHEN '2' THEN 'History of the planner' WHEN '3' THEN 'What is in ' || v WHEN '4' THEN 'What was fixed in the reader' ELSE 'How do I open a file' END AS query,
         v AS expected_version, CASE WHEN n = 0 THEN 'none' ELSE r END AS retrieved_version, least(n, 5) AS retrieved_chunks,
         n > 0 AND b.version_date > a.version_date AS temporal_leak, o_totalprice / 1000 AS retrieval_latency_ms
  FROM o JOIN cal a ON a.version = v JOIN cal b ON b.version = r)"""
WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '\s+'), lambda w: w <> '')"


def words_sql(column: str) -> str:
    return WORDS.format(column)


def bm25_sql(k: int, where: str = "true", all_statistics: bool = False, queries: str = "benchmark") -> str:
    """CTEs up to bm(query_id, id, score, rank, normalised). queries: a table with item_id and text."""
    return f"""dw AS (SELECT doc_id AS id, {WORDS.format("text")} AS words, ({where}) AS wanted FROM documents),
siz AS (SELECT id, len(words) AS size, wanted FROM dw WHERE {"true" if all_statistics else "wanted"}),
st AS (SELECT count(*) AS n, avg(size) AS mean FROM siz),
tok AS (SELECT id, unnest(words) AS term FROM dw WHERE {"true" if all_statistics else "wanted"}),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
fl AS (SELECT avg(idf) * 0.25 AS f FROM idf),
qtok AS (SELECT item_id AS query_id, unnest({WORDS.format("text")}) AS term FROM {queries}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY ALL),
sc AS (
  SELECT query_id, id, round(sum(qtf * (CASE WHEN idf < 0 THEN f ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 9) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN siz USING (id), fl, st WHERE wanted GROUP BY query_id, id),
bm0 AS (
  SELECT q.query_id, d.id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(score, 0.0) DESC, d.id) AS rank
  FROM (SELECT DISTINCT item_id AS query_id FROM {queries}) q CROSS JOIN (SELECT id FROM siz WHERE wanted) d LEFT JOIN sc USING (query_id, id)),
bm AS (
  SELECT query_id, id, score, rank, round(score / (CASE WHEN best > 0 THEN best ELSE 1 END), 4) AS normalised
  FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bm0 WHERE rank <= {k}))"""


def dense_sql(k: int) -> str:
    """CTEs, after bm25_sql, up to dn(query_id, id, score, rank)."""
    return f"""dv AS (SELECT id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*) AS c FROM tok GROUP BY ALL),
qv AS (SELECT query_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*) AS c FROM qtok GROUP BY ALL),
dl AS (SELECT id, sqrt(sum(c * c)) AS n FROM dv GROUP BY id), ql AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY query_id),
da AS (SELECT query_id, id, sum(qv.c * dv.c) AS dot FROM qv JOIN dv USING (b) GROUP BY query_id, id),
dn0 AS (SELECT query_id, id, round(dot / (ql.n * dl.n), 12) AS score FROM da JOIN ql USING (query_id) JOIN dl USING (id)),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn0) WHERE rank <= {k})"""


def fuse_sql(k: int, alpha: str, name: str = "hy", within: int = 1000) -> str:
    """A CTE, after bm and dn, of which the first ``within`` of each query count, with query_id, id, score, rank."""
    return f"""{name}0 AS (
  SELECT query_id, id, dn.rank AS dr, bm.rank AS br,
         round(CAST('{alpha}' AS DECIMAL(4,2)) * coalesce(CAST(round(dn.score, 4) AS DECIMAL(12,4)), 0) + (1 - CAST('{alpha}' AS DECIMAL(4,2))) * coalesce(CAST(bm.normalised AS DECIMAL(12,4)), 0), 4)::DOUBLE AS score
  FROM (SELECT * FROM dn WHERE rank <= {within}) dn FULL OUTER JOIN (SELECT * FROM bm WHERE rank <= {within}) bm USING (query_id, id)),
{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, br, id) AS rank FROM {name}0) WHERE rank <= {k})"""


_SPACE = r"[ \t\n\x0B\f\r]"
_LAST = "length(list_last(string_split(acc, chr(31))))"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def chunks_sql(source: str) -> str:
    """CTEs up to chunks(id, chunk_index, text) of source (id, text). Paragraphs and the sentences of long ones come as one list, each with a
    mark: P, a paragraph; F, a long one's first sentence; S, its others. The fold keeps chunks as one text, chr(31) between them."""
    sentences = rf"list_filter(string_split(regexp_replace(p, '([.!?]){_SPACE}+', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '')"
    return rf"""paras AS (
  SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n{{2,}}'), lambda p: {strip_sql("p")}), lambda p: p <> '') AS ps FROM {source}),
marked AS (
  SELECT id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 800 THEN ['P' || p] ELSE list_transform({sentences}, lambda x, i: CASE WHEN i = 1 THEN 'F' ELSE 'S' END || x) END)) AS ms FROM paras),
folded AS (
  SELECT id, list_reduce(list_concat([''], ms), lambda acc, x: CASE
    WHEN acc = '' THEN substr(x, 2)
    WHEN x[1] = 'P' AND {_LAST} + length(x) + 1 <= 800 THEN acc || chr(10) || chr(10) || substr(x, 2)
    WHEN x[1] = 'S' AND {_LAST} + length(x) <= 800 THEN acc || ' ' || substr(x, 2)
    ELSE acc || chr(31) || substr(x, 2) END) AS said FROM marked),
listed AS (SELECT id, list_filter(string_split(said, chr(31)), lambda c: length({strip_sql("c")}) > 20) AS cs FROM folded),
chunks AS (SELECT id, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS text FROM listed)"""


def typos_sql(source: str) -> str:
    """A subquery (item_id, text) with the typos of source (item_id, text)."""
    draw = lambda salt, i: f"('0x' || substr(md5(item_id || ':0:{salt}:' || ({i})), 1, 8))::BIGINT"
    at = f"(1 + {draw(2, 'i - 1')} % (length(x) - 2))"
    a, b, c, rest = f"substr(x, 1, {at})", f"substr(x, {at} + 1, 1)", f"substr(x, {at} + 2, 1)", f"substr(x, {at} + 3)"
    edit = f"CASE {draw(3, 'i - 1')} % 3 WHEN 0 THEN {a} || {c} || {b} || {rest} WHEN 1 THEN {a} || {c} || {rest} ELSE {a} || {b} || {b} || {c} || {rest} END"
    return rf"""(
  SELECT item_id, CASE WHEN len(w) < 2 OR len(el) = 0 THEN text ELSE array_to_string(list_transform(w, lambda x, i: CASE WHEN list_contains(ch, i - 1) THEN {edit} ELSE x END), ' ') END AS text
  FROM (SELECT *, list_transform(list_sort(list_transform(el, lambda e: {{'h': {draw(1, 'e')}, 'i': e}}))[1:2], lambda z: z.i) AS ch
    FROM (SELECT *, list_filter(range(len(w)), lambda e: length(w[e + 1]) > 4) AS el
      FROM (SELECT item_id, text, regexp_split_to_array(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+') AS w FROM {source}))))"""


#: Distinct words of a text that are all ASCII letters and digits, four or longer.
CONTENT = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{{4,}}')))"


def less_sql(words: str, stop: tuple[str, ...]) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in stop)
    return f"list_filter({words}, lambda w: NOT list_contains([{listed}], w))"


def any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def share_sql(words: str) -> str:
    """The share of words that ctx holds."""
    return f"CASE WHEN len({words}) = 0 THEN 1.0 ELSE len(list_filter({words}, lambda w: contains(ctx, w))) / len({words}) END"


def answer_sql(source: str, question: str, context: str) -> str:
    """A query of source's columns and the extracted answer."""
    return rf"""SELECT * EXCLUDE (asked, lines, ws, hits, best, part, dir), CASE WHEN best = '' THEN 'I could not find the answer in the provided documents.' WHEN contains(asked, 'directed by') THEN coalesce('Based on the context, ' || {strip_sql("dir")} || '.', 'Synthesized answer: ' || best)
  WHEN contains(asked, 'featuring') OR contains(asked, 'cast') THEN coalesce('The movie features cast members: ' || {strip_sql("replace(part, 'Cast:', '')")} || '.', 'Synthesized answer: ' || best) ELSE 'Synthesized answer: ' || best END AS answer
FROM (SELECT *, list_filter(string_split(best, '.'), lambda x: contains(lower(x), 'cast'))[1] AS part, list_filter(string_split(best, '.'), lambda x: contains(lower(x), 'directors') OR contains(lower(x), 'directed'))[1] AS dir
  FROM (SELECT *, CASE WHEN len(hits) > 0 THEN list_filter(hits, lambda x: length(x) = list_max(list_transform(hits, lambda y: length(y))))[1] ELSE coalesce(lines[1], '') END AS best
    FROM (SELECT *, list_filter(lines, lambda x: len(list_filter(ws, lambda w: contains(lower(x), w))) > 0) AS hits
      FROM (SELECT *, lower({question}) AS asked, list_filter(list_transform(string_split({context}, chr(10)), lambda x: {strip_sql("regexp_replace(" + strip_sql("x") + ", '^[- ]+', '')")}), lambda x: x <> '') AS lines,
        list_filter(regexp_split_to_array(lower(replace({question}, '?', '')), '{_SPACE}+'), lambda w: length(w) > 3) AS ws FROM {source}))))"""
