"""The training-data operators as queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .divergence import source_divergence
from .exact_dedup import exact_groups, normal_form
from .license_scan import license_statements
from .neighbours import nearest_vectors
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_qda import quality_scores
from .recurrent_lm import lm_scores
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .token_orc import tokenize
from .warc import archive_pages
from .winnow import contamination


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = docs.withColumn("text_sha256", F.sha2(normal_form("text").cast("binary"), 256))
    return exact_groups(digests, carry=["doc_id", "text_sha256"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_statements(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("statements").cast("long").alias("n_statements"),
        F.array_join(F.array_sort(F.array_distinct("statements.license")), ",").alias("licenses"),
        F.expr("aggregate(statements, 0L, (n, s) -> n + size(s.differences))").alias("n_differences"),
        F.expr("aggregate(statements, 0L, (n, s) -> n + s.saved)").alias("bytes_saved"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_recurrent_lm": op1_recurrent_lm,
        "op2_simhash": op2_simhash,
        "op3_quality": op3_quality,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_warc": op6_warc,
        "op7_packing": op7_packing,
        "op8_decontamination": op8_decontamination,
        "op9_token_orc": op9_token_orc,
        "op10_license_scan": op10_license_scan,
        "op11_source_divergence": op11_source_divergence,
        "op12_neighbours": op12_neighbours,
        "op13_prefix_trie": op13_prefix_trie,
    }


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS rn
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN owner END AS refers_to
FROM r
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT e.lang, source, term, e.n, 1 + (CAST(1000000000 AS HUGEINT) * (e.n + 5)) // (sum(e.n) OVER (PARTITION BY e.lang, source) + 5 * v.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 5)) // (v.total + 5 * v.v) AS q
  FROM every e JOIN v ON v.lang = e.lang
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), parts AS (
  FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""

#: The checksum is computed bit by bit; a node is the text of its turns' digests, 32 digits each.
OP13_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(text, '') AS txt, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, md5(said) AS tag, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) AS place FROM t
), c AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t
), crc(conv_id, s, i, v) AS (
  SELECT conv_id, s, 0, CAST(4294967295 AS BIGINT) FROM c
  UNION ALL
  SELECT conv_id, s, i + 1, xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT))
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE v END AS x FROM crc WHERE i < 8 * length(s))
), shared AS (
  SELECT conv_id, conv_id - conv_id % 100 AS hundred, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE i = 8 * length(s)
), made AS (
  SELECT s.conv_id, p.place, p.tag, p.txt FROM shared s JOIN placed p ON p.conv_id = s.hundred AND p.place <= s.h
  UNION ALL
  SELECT s.conv_id, p.place, p.tag, p.txt FROM shared s JOIN placed p ON p.conv_id = s.conv_id AND p.place > s.h
), paths AS (
  SELECT conv_id, txt, string_agg(tag, '') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM made
), whole AS (
  SELECT c.conv_id, coalesce(max(path), '') AS path FROM c LEFT JOIN paths p ON p.conv_id = c.conv_id GROUP BY c.conv_id
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(txt)) AS saved FROM paths GROUP BY path
  UNION ALL
  SELECT '', min(conv_id), count(*), 0 FROM c HAVING count(*) > 0
), children AS (
  SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE path <> '' GROUP BY 1
), up AS (
  SELECT left(n.path, 32 * k) AS path, sum(n.saved) AS saved, count(*) FILTER (WHERE ch.path IS NULL) AS leaves
  FROM (SELECT path, saved, unnest(range(0, length(path) // 32 + 1)) AS k FROM nodes) n LEFT JOIN children ch ON ch.path = n.path GROUP BY 1
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM whole GROUP BY path
)
SELECT n.conv_id, CAST(length(n.path) // 32 AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n, 0) AS n_children, up.leaves AS n_leaves,
       CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN up ON up.path = n.path LEFT JOIN children ch ON ch.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.path <> '' AND p.path = left(n.path, length(n.path) - 32)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_warc": OP6_SQL, "op11_source_divergence": OP11_SQL, "op13_prefix_trie": OP13_SQL}
