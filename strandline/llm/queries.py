"""Queries of the corpus operators over the driver's tables, each over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from strandline.llm import byte_bpe, edit_fingerprint, language_id, mixing, mpeg_audio, ngram_join, pii, prefix_trie, substring_dedup, suffix_dedup, token_alignment, url_filter, warc

#: The key of pseudonyms where the session names none in ``spark.strandline.pii.key``; real runs set their own secret.
PII_KEY = b"strandline demonstration key 001"


def pii_key(spark: SparkSession) -> bytes:
    named = spark.conf.get("spark.strandline.pii.key", None)
    return named.encode() if named else PII_KEY


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_documents(spark, sf_dir), 20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_documents(spark, sf_dir), 50)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.digest(_documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark), with_spans=True).withColumn("n_found", F.coalesce(F.size("pii_spans"), F.lit(0)))


def op10_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.digest(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: (host, beginning of the path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: Removal of words under windows of ``width`` that also start earlier.
_REPEATS = """WITH n AS (SELECT doc_id, coalesce({words}, []) AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {width} - 1], ' ')) AS h FROM n, unnest(range(1, len(ws) - {width} + 2)) AS t(i)),
f AS (SELECT h, min((doc_id, i)) AS first FROM g GROUP BY h), r AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE (doc_id, i) <> first),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, unnest(range(0, {width})) AS t(k)), w AS (SELECT doc_id, i, ws[i] AS word FROM n, unnest(range(1, len(ws) + 1)) AS t(i)),
k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT n.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE size >= 1000 GROUP BY digest)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM p LEFT JOIN k USING (digest)"""

_LINKS = """WITH RECURSIVE n AS (SELECT doc_id, coalesce({words}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM n, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS t(i)),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN z a ON x = a.doc_id JOIN z b ON y = b.doc_id WHERE 100 * common >= 85 * (a.size + b.size - common)),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x)
SELECT r.doc_id, coalesce(any_value(z.size), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM r LEFT JOIN z ON r.doc_id = z.doc_id GROUP BY 1"""

_URL_RULES = """WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages), r(h, p, verdict) AS (VALUES {rules}),
d AS (SELECT DISTINCT host, path FROM p), b AS (SELECT d.host, d.path, max((length(r.h), length(r.p), r.h || r.p, r.verdict)) AS best FROM d JOIN r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p) GROUP BY ALL)
SELECT page_id, host, path, best[3] AS rule, coalesce(best[4], 'allow') AS verdict FROM p LEFT JOIN b USING (host, path)"""

#: A path is its turns' MD5 digests, so a node's ancestors are the beginnings of its path; the CRC-32 goes bit by bit.
_TRIE = """WITH t AS (SELECT conv_id AS c, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, k, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS n FROM t),
i AS (SELECT DISTINCT c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda j: [ascii(substr(c::VARCHAR, j, 1)), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 AS h FROM n),
m AS (SELECT i.c, n.n AS pos, k, size FROM i JOIN n ON n.c = i.c - i.c % 5 AND n.n <= h UNION ALL SELECT i.c, n.n, k, size FROM i JOIN n ON n.c = i.c AND n.n > h),
p AS (SELECT c, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path, size FROM m WINDOW w AS (PARTITION BY c ORDER BY pos) UNION ALL SELECT c, 0, '', 0 FROM i),
e AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(path, depth) AS path FROM p GROUP BY c) GROUP BY path),
d AS (SELECT path, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved FROM p GROUP BY path),
k AS (SELECT left(path, (32 * (depth - 1))::BIGINT) AS path, count(*) AS n_children FROM d WHERE depth > 0 GROUP BY 1),
s AS (SELECT left(d.path, (32 * j)::BIGINT) AS path, sum((n_children IS NULL)::INT) AS n_leaves, sum(saved) AS saved, count(*) AS nodes FROM (d LEFT JOIN k USING (path)) AS d, unnest(range(0, depth + 1)) AS u(j) GROUP BY 1),
o AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS preorder FROM d)
SELECT d.conv_id, d.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, d.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256, preorder, preorder + nodes - 1 AS subtree_end
FROM d JOIN s USING (path) JOIN o USING (path) LEFT JOIN k ON k.path = d.path LEFT JOIN e ON e.path = d.path LEFT JOIN d AS up ON d.depth > 0 AND up.path = left(d.path, (32 * (d.depth - 1))::BIGINT)"""


def oracle_sql() -> dict[str, str]:
    words = _WORDS.format(text="text")
    lower = _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return {
        "op1_substring_dedup": _REPEATS.format(words=words, width=20),
        "op2_warc": _WARC,
        "op4_suffix_dedup": _REPEATS.format(words=words, width=50),
        "op7_ngram_join": _LINKS.format(words=lower),
        "op12_prefix_trie": _TRIE,
        "op13_url_filters": _URL_RULES.format(rules=", ".join(map(str, URL_RULES))),
    }
