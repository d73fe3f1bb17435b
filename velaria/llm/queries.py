"""The queries of this subpackage, and the SQL that each must agree with where SQL can say it."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from velaria.llm import chats, credentials, decontaminate, interactions, langid, minhash, packing, perplexity, pseudonyms, rans, recurrent
from velaria.llm import sharding, tokens, veccodes
from velaria.llm.common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), tokens.tokenizer_path())


@query("op10_rans_archive")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids from the compressed files."""
    return rans.documents_in(spark, rans.archive(table(spark, sf_dir, "documents"), tokens.tokenizer_path()))


@query("op5_minhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


WORDS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[0-9a-z\x{80}-\x{10FFFF}]+')"
)
CONTAMINATION_SQL = f"""
WITH dw AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM {{documents}}),
iw AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
dg AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, size, item_id FROM dg JOIN wins USING (g, size)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""


@query("op2_decontamination", CONTAMINATION_SQL.replace("{documents}", "documents"))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("text_key")


@query("op6_slot_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = table(spark, sf_dir, "documents")
    return credentials.scan(docs, keep=["doc_id"], words=credentials.ranked_words(docs))


@query("op9_feistel_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms under the session's key.

    A session without `velaria.pseudonym.key` gets a random one, which is in its settings from then on: no published
    key can undo a pseudonym, and whoever needs the same ones in another session sets the key.
    """
    key = spark.conf.get("velaria.pseudonym.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("velaria.pseudonym.key", key)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key)


@query("op1_perplexity_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and perplexity bands over all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = written(perplexity.score(docs, perplexity.fit(docs), keep=["doc_id", "lang"]), "scored")
    return perplexity.judge(scored).drop("lang")


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    own = docs.select("doc_id", langid.held_out("doc_id").alias("held_out"), "text")
    return langid.predict(own, model, keep=["doc_id", "held_out"])


@query("op7_recurrent_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every document."""
    docs = table(spark, sf_dir, "documents")
    return recurrent.score(docs, *recurrent.fit(docs))


# Characters a control string gains when it is escaped, and those that a turn's marks add.
_ESCAPES = r"len(regexp_extract_all({0}, '[<\[]\\*(?:/?s>|/?INST\]|/?SYS\]|/?ROLE\]|END\]|\|endoftext\|>)'))"
CHATS_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + {_ESCAPES.format("text")} + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 8
    ELSE 19 + length(role) + {_ESCAPES.format("role")} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op11_masked_chats", CHATS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    path = tokens.tokenizer_path()
    return chats.read_back(chats.format_chats(rows, path), path)


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, bit)),
o AS (
  SELECT b1.x || b2.x || b3.x || b4.x || b5.x AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
  FROM b b1, b b2, b b3, b b4, b b5 WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31
    AND b1.bit | b2.bit | b3.bit | b4.bit | b5.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step]) - bits[step] AS before FROM o, range(1, 6) AS r(step)),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in all orders."""
    return interactions.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_NEAREST_SQL = """
a{0} AS MATERIALIZED (
  SELECT row, pos, min(far * 64 + entry) % 64 AS entry, min(far * 64 + entry) // 64 AS far
  FROM (SELECT row, c.pos, entry, sum((x - y) * (x - y)) AS far FROM c JOIN b{0} AS b ON b.pos = c.pos AND b.k = c.k GROUP BY row, c.pos, entry)
  GROUP BY row, pos)"""
_MOVED_SQL = """
m{0} AS MATERIALIZED (SELECT a.pos, a.entry, c.k, sum(x) AS s, count(*) AS n FROM a{0} AS a JOIN c ON c.row = a.row AND c.pos = a.pos GROUP BY a.pos, a.entry, c.k),
b{1} AS MATERIALIZED (
  SELECT b.pos, b.entry, b.k, CAST(coalesce((s - (s % n + n) % n) // n, y) AS BIGINT) AS y
  FROM b{0} AS b LEFT JOIN m{0} AS m ON m.pos = b.pos AND m.entry = b.entry AND m.k = b.k)"""
CODES_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, len(embedding) // 16 AS width,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT row, i // width AS pos, i % width AS k, x FROM (SELECT row, width, unnest(ints) AS x, unnest(range(len(ints))) AS i FROM v)),
b0 AS MATERIALIZED (SELECT pos, row - 1 AS entry, k, x AS y FROM c WHERE row <= 64),
{_NEAREST_SQL.format(0)}, {_MOVED_SQL.format(0, 1)}, {_NEAREST_SQL.format(1)}, {_MOVED_SQL.format(1, 2)}, {_NEAREST_SQL.format(2)},
e AS (SELECT row, lower(string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY pos)) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY pos, entry, k)) FROM b2) AS codebooks_sha256
FROM v JOIN e USING (row)
"""


@query("op13_trie_codes", CODES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, 16 parts of 64 entries."""
    vectors = table(spark, sf_dir, "embeddings")
    books = veccodes.fit(vectors)
    coded = veccodes.with_label_errors(written(veccodes.encode(vectors, books), "codes"))
    digest = books.sha256() if books else None
    return coded.select(
        F.col("id").alias("vec_id"), veccodes.hex_codes(F.col("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
