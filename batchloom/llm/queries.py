"""The thirteen operators applied to their whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import package_on_workers
from . import op01_repair, op02_balance, op03_pstable, op04_shuffle, op05_oddsketch, op06_media, op07_nnpu, op08_slack, op09_secrets, op11_trie, op12_warc, op13_spelling
from . import op10_ppm as ppm
from .store import landed

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return package_on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = op01_repair.write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return op01_repair.document_digests(blocks)


def op2_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op02_balance.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies", "cut_words")


def op3_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_pstable.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, manifest = op04_shuffle.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text, key = F.coalesce(F.col("record.text").cast("string"), F.lit("")), F.col("record.doc_id").cast("long")
    thin = written.select(
        "shard", "bucket", "place", key.alias("doc_id"), op04_shuffle.text_bytes(F.col("record.text").cast("string")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), op04_shuffle.shard_of(key, op04_shuffle.SHARDS + 1).alias("grown_shard"),
    )
    return op04_shuffle.slots(thin, manifest).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_oddsketch.near_duplicates(table(spark, sf_dir, "documents"), similar=(85, 100))


def op6_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_media.features(landed(op06_media.store(table(spark, sf_dir, "documents")), "media"))


def op7_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op07_nnpu.score(docs, op07_nnpu.fit(docs, table(spark, sf_dir, "labels")))


def op8_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_slack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.identify(docs, ppm.fit(docs))


def op11_trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_trie.trie(table(spark, sf_dir, "conversations"))


def op12_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = op12_warc.write_archives(table(spark, sf_dir, "pages"))
    return op12_warc.pages_of(landed(op12_warc.read_pages(spark, archives), "pages"))


def op13_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling.spelling(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_repair, op2_entropy_balance, op3_pstable, op4_external_shuffle, op5_odd_sketches, op6_signatures, op7_nnpu, op8_bin_slack, op9_token_efficiency, op10_ppm, op11_trie_nodes, op12_segments, op13_wavelet)
}

#: Cosines over all pairs of a label, components by recursion.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w
), comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
deg AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, coalesce(d.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.u = v.vec_id LEFT JOIN deg d ON d.u = v.vec_id
"""

#: Shingle sets joined on shared shingles, components by recursion.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x != '') AS ws FROM documents
), sh AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT doc_id AS u, doc_id AS v FROM sh UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT sh.doc_id, len(s)::BIGINT AS n_shingles, component_id, sh.doc_id = component_id AS kept FROM sh JOIN comp ON comp.u = sh.doc_id
"""

#: CRC-32 of a list of bytes ``{bytes}``, by its table ``t``.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"
CRC = "xor(4294967295, list_reduce({bytes}, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT))"

#: Nodes by grouping whole prefixes, subtrees by every node's prefixes.
OP11_SQL = f"""
WITH crc AS ({CRC_TABLE}), c AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list((role, text) ORDER BY turn NULLS FIRST, role, md5(text)) AS own,
    {CRC.format(bytes="list_transform(range(1, strlen(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1)))")} % 6 AS h
  FROM c, crc GROUP BY conv_id, t
), seqs AS (
  SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS s FROM convs a LEFT JOIN convs b ON b.conv_id = a.conv_id - a.conv_id % 100
), members AS (SELECT conv_id, unnest(range(len(s) + 1)) AS d, s[1:d] AS p, len(s) AS l FROM seqs),
nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = l), '')) AS ends_sha256 FROM members GROUP BY p, d
), kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth),
up AS (SELECT unnest(range(depth + 1)) AS d, p[1:d] AS above, (n_children = 0)::BIGINT AS leaf, CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth][2]) ELSE 0 END AS saved FROM full_nodes),
sums AS (SELECT above AS p, d AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.p = n.p AND s.depth = n.depth LEFT JOIN nodes m ON n.depth > 0 AND m.p = n.p[1:n.depth - 1] AND m.depth = n.depth - 1
"""

#: Payloads and the largest page_id of equal long ones.
OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, strlen(html) AS bytes, row_number() OVER w AS nth, first_value(page_id) OVER w AS top FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN bytes >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND nth > 1 THEN top END AS refers_to, NULL::VARCHAR AS problem FROM r
"""

#: Near words by what is left of a word without one letter.
OP13_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc, run),
coded AS (SELECT doc, run, n, list_transform(string_split(doc || ':' || run, ''), lambda x: ord(x)) AS points FROM counted),
hashed AS (
  SELECT run, n, {CRC.format(bytes="flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))")} AS h FROM coded, crc
), cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words),
pairs AS (
  SELECT a.word AS u, b.word AS v, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), near AS (SELECT u AS word, count(*) AS n_near, max(n) AS most FROM (SELECT DISTINCT u, v, n FROM pairs) GROUP BY u),
best AS (SELECT p.u AS word, min(p.v) AS form, any_value(most) AS most FROM pairs p JOIN near ON near.word = p.u AND near.most = p.n GROUP BY p.u),
forms AS (SELECT w.word, w.n, coalesce(near.n_near, 0) AS n_near, CASE WHEN best.most >= 2 * w.n THEN best.form END AS form, CASE WHEN best.most >= 2 * w.n THEN best.most END AS form_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.word = f.word JOIN forms e ON e.word = way.at AND e.form IS NULL
"""

ORACLES: dict[str, str] = {"op3_pstable": OP3_SQL, "op5_odd_sketches": OP5_SQL, "op11_trie_nodes": OP11_SQL, "op12_segments": OP12_SQL, "op13_wavelet": OP13_SQL}
