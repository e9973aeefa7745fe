"""The queries of the text operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airfill.llm import (bpe, brown_lm, chat, exact_dedup, fertility, huffman, merkle, packing, pii, rule_ensemble, simhash, spelling,
                         weak_toxicity)
from airfill.llm.runtime import documents

Query = Callable[[SparkSession, str], DataFrame]

#: A conversation whose texts are made of control strings, added to those of the table.
PROBE = "SELECT -1L conv_id, turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') t(turn, role)"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(spark.sql(PROBE))))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rules(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir), exact_dedup.fresh_index(spark))


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_corpus(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.shown(simhash.near_groups(documents(spark, sf_dir), shingle=4, distance=4))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


def op12_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.written_and_read(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_chat": op3_chat,
    "op4_fertility": op4_fertility,
    "op5_bpe": op5_bpe,
    "op6_weak_toxicity": op6_weak_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_brown_lm": op8_brown_lm,
    "op9_pii": op9_pii,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_huffman": op12_huffman,
    "op13_spelling": op13_spelling,
}
#: The escaped text: a backslash doubled, each control string broken after its first character.
_ESCAPED = "replace(text, '\\', '\\\\')"
for _c in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_NAME = _ESCAPED.replace("(text,", "(role,")

#: A relation ``crc(t)`` with the table of the checksum's 256 bytes, made from its polynomial.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
#: A field of a leaf.
_FIELD = "coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def crc32(octets: str) -> str:
    """SQL for the unsigned checksum of a list of bytes, beside ``crc``."""
    return (f"xor(list_reduce(list_concat([4294967295], coalesce({octets}, [])), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


SQL: dict[str, str] = {
    "op3_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, {_ESCAPED} AS escaped, {_NAME} AS name, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN previous = role THEN 5 WHEN role = 'user' THEN 13
           WHEN role = 'assistant' THEN 7 WHEN role = 'system' THEN 15 ELSE 22 + length(name) END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
    "op7_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_merkle": f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || lang, '0') AS g, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded,
    {_FIELD.format(c="doc_id")} || {_FIELD.format(c="source")} || {_FIELD.format(c="lang")} || {_FIELD.format(c="n_chars")} AS head,
    {_FIELD.format(c="text")} AS body,
    {crc32("list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 3 = 0 AS tampered
  FROM documents CROSS JOIN crc),
r AS (
  SELECT rid, doc_id, g, sha256(head || body) AS leaf,
    sha256(head || CASE WHEN tampered THEN {_FIELD.format(c="folded")} ELSE body END) AS shown,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS idx,
    count(*) OVER (PARTITION BY g) AS n
  FROM d),
nodes(g, h, idx, digest, n) AS (
  SELECT g, 0, idx, leaf, n FROM r
  UNION ALL
  SELECT g, h + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM nodes WHERE n > 1
  GROUP BY g, h, n, idx // 8),
subroots AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(h, idx, digest, n) AS (
  SELECT 0, idx, digest, n FROM subroots
  UNION ALL
  SELECT h + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM upper WHERE n > 1
  GROUP BY h, n, idx // 8),
runs AS (SELECT g, h, idx // 8 AS up, list(digest ORDER BY idx) AS kids FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT h, idx // 8 AS up, list(digest ORDER BY idx) AS kids FROM upper WHERE n > 1 GROUP BY ALL),
walk(rid, g, h, idx, n, now, proof) AS (
  SELECT rid, g, 0, idx, n, shown, '' FROM r
  UNION ALL
  SELECT w.rid, w.g, w.h + 1, w.idx // 8, (w.n + 7) // 8,
    sha256(array_to_string(kids[:w.idx % 8], '') || w.now || array_to_string(kids[w.idx % 8 + 2:], '')),
    w.proof || array_to_string(kids[:w.idx % 8], '') || array_to_string(kids[w.idx % 8 + 2:], '')
  FROM walk w JOIN runs ON w.g = runs.g AND w.h = runs.h AND w.idx // 8 = runs.up WHERE w.n > 1),
climb(rid, h, idx, n, now, proof) AS (
  SELECT rid, 0, s.idx, s.n, now, proof FROM walk w JOIN subroots s USING (g) WHERE w.n = 1
  UNION ALL
  SELECT w.rid, w.h + 1, w.idx // 8, (w.n + 7) // 8,
    sha256(array_to_string(kids[:w.idx % 8], '') || w.now || array_to_string(kids[w.idx % 8 + 2:], '')),
    w.proof || array_to_string(kids[:w.idx % 8], '') || array_to_string(kids[w.idx % 8 + 2:], '')
  FROM climb w JOIN upper_runs u ON w.h = u.h AND w.idx // 8 = u.up WHERE w.n > 1)
SELECT r.doc_id, r.leaf, s.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.now AS folded_root,
  c.now = t.digest AS verified
FROM r JOIN climb c ON c.rid = r.rid AND c.n = 1 JOIN subroots s ON s.g = r.g CROSS JOIN (SELECT digest FROM upper WHERE n = 1) t""",
    "op13_spelling": f"""
WITH RECURSIVE {CRC_TABLE},
own AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM own GROUP BY ALL),
sums AS (
  SELECT run, n, {crc32("""flatten(list_transform(str_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))""")} AS h
  FROM runs CROSS JOIN crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM sums GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a || '*' || x.b = y.a || '*' || y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m FROM near GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN best END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, reached, further) AS (
  SELECT word, word, form FROM told
  UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.further)
SELECT told.word, form, reached AS root, n, n_near, form_n FROM told JOIN chain ON chain.word = told.word AND further IS NULL""",
}
