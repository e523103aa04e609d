"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.chat import format_chats, read_chats, threads
from chatloom.llm.collocations import collocations
from chatloom.llm.content_sort import content_sort
from chatloom.llm.language_id import identify
from chatloom.llm.line_dedup import line_dedup
from chatloom.llm.media import media_column, media_features
from chatloom.llm.minhash import near_duplicates
from chatloom.llm.mixing import mix_sources, taken_words
from chatloom.llm.neighbour_votes import quality_votes
from chatloom.llm.prefix_bpe import encode_and_decode
from chatloom.llm.toxicity import toxicity
from chatloom.llm.vector_codes import compress
from chatloom.llm.warc import archived

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


QUERIES["op2_content_sort"] = op2_content_sort
ORACLE_SQL["op2_content_sort"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


QUERIES["op5_prefix_bpe"] = op5_prefix_bpe


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(table(spark, sf_dir, "documents")))


QUERIES["op10_mixing"] = op10_mixing


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES["op7_minhash"] = op7_minhash
ORACLE_SQL["op7_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
numbered AS (SELECT doc_id, hash(s) AS h FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM numbered a JOIN numbered b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON node = d.doc_id
"""


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archived(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


QUERIES["op1_warc"] = op1_warc
ORACLE_SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, CAST(1 + (5 * i) // 4 AS INT), 2))::INT >> (3 - (5 * i) % 4)::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, true AS verified
FROM k
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "removed_lines", "text")


QUERIES["op3_line_dedup"] = op3_line_dedup


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_column(table(spark, sf_dir, "documents")))


QUERIES["op4_media"] = op4_media


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity(table(spark, sf_dir, "documents"), labels)


QUERIES["op6_toxicity"] = op6_toxicity


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return identify(table(spark, sf_dir, "documents"), held_out)


QUERIES["op8_language_id"] = op8_language_id


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(threads(rows))
    return read_chats(chats).withColumnRenamed("tree", "conv_id")


QUERIES["op9_chat"] = op9_chat
ORACLE_SQL["op9_chat"] = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
    + (length(text) - length(replace(text, '<|turn|>', ''))) // 8 + (length(text) - length(replace(text, '<|/turn|>', ''))) // 9
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 AS chars FROM every)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + length(role) + 18) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES["op12_vector_codes"] = op12_vector_codes


def _assignment(parts: str, books: str) -> str:
    """SQL of the nearest entry of every part: a squared distance for each pair, the least by (distance, entry)."""
    return f"""
  SELECT i, p, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT i, p, x, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k]))) AS BIGINT) AS d
    FROM {parts} JOIN {books} USING (p)) GROUP BY i, p, x"""


def _moved(assigned: str, books: str) -> str:
    """SQL of the codebooks after a round: floors of means, and entries without parts as they were."""
    return f"""
  SELECT p, e, CASE WHEN m IS NULL THEN c ELSE m END AS c FROM {books} LEFT JOIN (
    SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY k) AS m FROM (
      SELECT p, e, k, sum(x[k]) AS s, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS k) GROUP BY p, e, k)
    GROUP BY p, e) USING (p, e)"""


ORACLE_SQL["op12_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT i, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
books0 AS MATERIALIZED (SELECT p, i - 1 AS e, x AS c FROM parts WHERE i <= 64),
near0 AS MATERIALIZED ({_assignment("parts", "books0")}),
books1 AS MATERIALIZED ({_moved("near0", "books0")}),
near1 AS MATERIALIZED ({_assignment("parts", "books1")}),
books2 AS MATERIALIZED ({_moved("near1", "books1")}),
near2 AS MATERIALIZED ({_assignment("parts", "books2")}),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 JOIN kept USING (i) GROUP BY i, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256
FROM coded
"""


def op11_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return quality_votes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


QUERIES["op11_neighbour_votes"] = op11_neighbour_votes


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES["op13_collocations"] = op13_collocations
ORACLE_SQL["op13_collocations"] = r"""
WITH pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, h.k, h.f AS l, r.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (h.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM candidates c JOIN f h ON h.lang = c.lang AND h.k < c.size AND h.phrase = array_to_string(c.w[1 : h.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.size - h.k AND r.phrase = array_to_string(c.w[h.k + 1 : c.size], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part AS phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE size = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM lowest LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""
