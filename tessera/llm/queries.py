"""The registered queries of the corpus operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, conversations, decontam, exact_dedup, html_text, line_dedup, ngram_join, quality, secret_scan, simhash, spelling, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda no: F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _predicted(toxicity.score(docs, model), 0.5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _predicted(quality.score(docs, model), 0.3)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_dropped", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def _with_imports(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {k: _with_imports(f) for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k[4:].lower(): " ".join(v.split()) for k, v in globals().items() if k.startswith("SQL_")}


SQL_OP1_EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

SQL_OP6_DECONTAMINATE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS t
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
gram AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS t
  FROM low, sizes, unnest(range(1, len(w) - size + 2)) AS r(i) WHERE len(w) >= size),
occ AS (SELECT DISTINCT doc_id, i, size, item_id FROM gram JOIN win USING (size, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + size)) AS q(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL_OP2_NGRAM_JOIN = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.c = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

SQL_OP4_WARC = r"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, CAST(from_hex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages),
g AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY bits) AS first,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5*i+1] AS INT) + 8 * CAST(bits[5*i+2] AS INT) + 4 * CAST(bits[5*i+3] AS INT) + 2 * CAST(bits[5*i+4] AS INT) + CAST(bits[5*i+5] AS INT), 1) FOR i IN range(32)], '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM g
"""

#: crc32 of the bytes of the text that stands for {0}; step holds the remainders of all bytes.
_STEP = "step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS of)"
_CRC = "xor(list_reduce(list_transform(range(strlen({0})), lambda k: CAST('0x' || substr(hex({0}), CAST(2 * k + 1 AS INT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, step.of[CAST(1 + (xor(c, b) & 255) AS INT)]), CAST(4294967295 AS BIGINT)), 4294967295)"

SQL_OP12_CONVERSATION_TRIE = (
    "WITH RECURSIVE "
    + _STEP
    + r""",
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, """
    + _CRC.format("CAST(conv_id AS VARCHAR)")
    + r""" % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), step),
rebuilt AS (SELECT c.conv_id, t.pos, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos + 1000, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (SELECT conv_id, sha256(length(role)::VARCHAR || ':' || role || text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt),
path AS (SELECT conv_id, depth, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS p, max(depth) OVER (PARTITION BY conv_id) AS size FROM placed
  UNION ALL SELECT conv_id, 0, 0, '', coalesce(s, 0) FROM conv LEFT JOIN (SELECT conv_id, max(depth) AS s FROM placed GROUP BY conv_id) USING (conv_id)),
node AS (SELECT p, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends FROM path GROUP BY p),
kid AS (SELECT left(p, length(p) - 64) AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
below AS (SELECT top.p, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved FROM node x
  LEFT JOIN kid k ON k.p = x.p, unnest(range(0, x.depth + 1)) AS r(d) JOIN node top ON top.p = left(x.p, 64 * r.d) GROUP BY top.p)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kid.n, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n LEFT JOIN kid ON kid.p = n.p JOIN below ON below.p = n.p LEFT JOIN node up ON n.depth > 0 AND up.p = left(n.p, length(n.p) - 64)
"""
)

SQL_OP13_SPELLING = (
    "WITH RECURSIVE "
    + _STEP
    + r""",
run AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, c, """
    + _CRC.format("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")
    + r""" AS h FROM run, step),
word AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) + 2 AS INT)) ELSE w END AS word, c FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
gap AS (SELECT word, n, left(word, CAST(i AS INT)) || '*' || substr(word, CAST(i + 2 AS INT)) AS replaced, left(word, CAST(i AS INT)) || substr(word, CAST(i + 2 AS INT)) AS less FROM word, unnest(range(0, length(word))) AS r(i)),
one AS (SELECT a.word AS a, b.word AS b FROM gap a JOIN gap b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gap g JOIN word w ON w.word = g.less UNION SELECT w.word, g.word FROM gap g JOIN word w ON w.word = g.less),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM one JOIN word ON word = b GROUP BY a),
form AS (SELECT word.word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * word.n THEN top END AS form_n FROM word LEFT JOIN best ON a = word.word),
chosen AS (SELECT o.a, min(o.b) AS form FROM one o JOIN word w ON w.word = o.b JOIN form f ON f.word = o.a AND w.n = f.form_n GROUP BY o.a),
known AS (SELECT f.word, n, n_near, form_n, c.form FROM form f LEFT JOIN chosen c ON c.a = f.word),
walk AS (SELECT word, word AS root FROM known UNION SELECT walk.word, k.form FROM walk JOIN known k ON k.word = walk.root WHERE k.form IS NOT NULL),
last AS (SELECT w.word, w.root FROM walk w JOIN known k ON k.word = w.root WHERE k.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN last USING (word)
"""
)
